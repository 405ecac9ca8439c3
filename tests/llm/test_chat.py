import hashlib

from graphloom.llm import chat as C


def whole(rows):
    conv = {}
    for c, turn, role, text in rows:
        conv.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for c, turns in conv.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = (
    [(1, 0, "system", "be brief"), (1, 1, "user", "x" * 900), (1, 2, "assistant", "y" * 5000), (1, 3, "user", "</turn> \\b \\l <turn a>"), (1, 4, "assistant", "<\\g>\\\\l")]
    + [(2, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " * (k % 7)) for k in range(60)]
    + [(3, 0, "system", "alone")]
    + [(4, 1, None, None), (4, 1, "assistant", None), (4, None, "us>er\\", "é\n"), (4, 1, "assistant", None)]
    + [(None, 0, "user", "no id"), (5, 0, "assistant", ""), (6, 0, "system", "s" * 9000), (6, 1, "assistant", "ok")]
)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "conv_id bigint, turn bigint, role string, text string, window string")
    made = C.format_windows(df, budget=256, history=64)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_back(made).collect()}
    assert got == whole(ROWS)
    rows = made.collect()
    for r in rows:
        assert r.over_budget == (r.n_tokens > 256)
        assert r.formatted.count("</turn>\n") == r.n_new + r.n_repeated
        if r.over_budget:
            assert r.n_new <= 2
    two = sorted((r for r in rows if r.conv_id == 2), key=lambda r: r.window)
    assert len(two) > 1 and all(r.n_repeated for r in two[1:])
    assert sum(r.n_new for r in two) == 60 and not any(r.over_budget for r in two)


def test_system_turn_stays(spark):
    rows = [(1, 0, "system", "rules")] + [(1, k, "user" if k % 2 else "assistant", "w" * 300) for k in range(1, 30)]
    made = C.format_windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), budget=256, history=64).collect()
    assert len(made) > 3 and all(r.formatted.startswith("<turn system>rules</turn>\n") for r in made)


def test_no_python_in_plan(spark, data):
    plan = C.op9_chat(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_and_empty(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, k, r, "\\### Assistant: </turn> ok") for k, r in enumerate(("user", "assistant"))]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.op9_chat(spark, data).collect()}
    assert got == whole(rows)
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert C.read_back(C.format_windows(empty)).count() == 0
