"""Chat formatting in budgeted windows of whole turns, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OPEN, BETWEEN, CLOSE = "<turn ", ">", "</turn>\n"
CHARS_PER_TOKEN = 4


def escape(text: Column) -> Column:
    """Text without any "<": no control string of the template can occur in it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The inverse of escape(): each backslash is followed by b, l or g, so the order of replacing doesn't matter."""
    out = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def format_windows(
    conversations: DataFrame,
    budget: int = 1024,
    history: int = 256,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, n_new, n_tokens, over_budget, targets): the training samples of each conversation.

    A sample is the system turn, the turns before its span that fit whole into
    history tokens, and a span of new turns.  Spans come from prefix sums of
    turn tokens (characters over 4, rounded up): a span ends with the first
    turn that carries the sum over a multiple of half of the budget's rest, so
    that the sample stays within budget; a longer turn is alone in its span, is
    never cut, and marks its sample over_budget if need be.  Every turn is new
    in one sample exactly.  targets are the character ranges (end exclusive)
    of the escaped texts of new assistant turns: repeated ones are masked.

    Null texts and roles count as empty.  Equal turn numbers are ordered by
    role and text, null turns come first; repeated rows are turns of their own.
    A null conv_id is a conversation like others.  Other columns are ignored.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\g")), F.lit(BETWEEN)))
    rows = rows.withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("chars", F.length("head") + F.length("body") + F.lit(len(CLOSE)))
    rows = rows.withColumn("tokens", F.ceil(F.col("chars") / CHARS_PER_TOKEN).cast("bigint"))

    conv = W.partitionBy("conv_id")
    by_turn = conv.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select("*", F.row_number().over(by_turn).alias("pos"), F.count("*").over(conv).alias("n"))
    rows = rows.withColumn("sys", (F.col("pos") == 1) & (F.col("role") == "system") & (F.col("n") > 1))
    by_pos = conv.orderBy("pos")
    upto = by_pos.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = lambda c: F.when(F.col("sys"), F.lit(0)).otherwise(F.col(c))
    rows = rows.select(
        "*",
        F.max(F.when(F.col("sys"), F.col("tokens")).otherwise(0)).over(conv).alias("sys_tokens"),
        F.max(F.when(F.col("sys"), F.col("chars")).otherwise(0)).over(conv).alias("sys_chars"),
        (F.sum(own("tokens")).over(upto) - own("tokens")).alias("before"),
        (F.sum(own("chars")).over(upto) - own("chars")).alias("chars_before"),
    )
    rows = rows.withColumn("room", F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("sys_tokens")) / 2)))
    rows = rows.withColumn("alone", F.col("sys") | (F.col("tokens") > F.col("room")))
    change = F.col("alone") | F.coalesce(F.lag("alone").over(by_pos), F.lit(True))
    rows = rows.withColumn("change", change.cast("int"))
    rows = rows.withColumn("run", F.sum("change").over(upto))
    runs = W.partitionBy("conv_id", "run")
    rows = rows.withColumn("slot", F.floor((F.col("before") - F.min("before").over(runs)) / F.col("room")))
    spans = W.partitionBy("conv_id", "run", "slot")
    near = conv.orderBy("before").rangeBetween(-history, 0)
    rows = rows.select(
        "*",
        (F.min("pos").over(spans) == F.col("pos")).alias("first"),
        F.max("pos").over(spans).alias("last"),
        F.max(F.col("chars_before") + F.col("chars")).over(spans).alias("chars_end"),
        F.sum("tokens").over(spans).alias("new_tokens"),
        F.greatest(F.min("pos").over(near), F.when(F.col("sys_tokens") > 0, 2).otherwise(1)).alias("since"),
    )
    turns = rows.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "sys", "first", "last", "since", "before", "chars_before", "new_tokens",
                    F.when(F.col("role") == target_role, F.length("head")).alias("text_at"), F.length("body").alias("text_chars"), "sys_chars", "sys_tokens",
                )
            )
        ).alias("t")
    )
    turns = turns.select("conv_id", "t", F.filter("t", lambda x: x["first"] & ~x["sys"]).alias("s"))
    each = turns.select("conv_id", "t", F.posexplode("s").alias("window", "s"))
    system = F.slice("t", 1, F.when(F.col("s.sys_tokens") > 0, 1).otherwise(0))
    earlier = F.slice("t", F.col("s.since"), F.col("s.pos") - F.col("s.since"))
    new = F.slice("t", F.col("s.pos"), F.col("s.last") - F.col("s.pos") + 1)
    each = each.select("conv_id", "window", "s", system.alias("system"), earlier.alias("earlier"), new.alias("new"))
    back = F.coalesce(F.try_element_at("earlier", F.lit(1))["chars_before"], F.col("s.chars_before"))
    base = F.col("s.sys_chars") + F.col("s.chars_before") - back
    start = lambda x: base + x["chars_before"] - F.col("s.chars_before") + x["text_at"]
    tokens = F.col("s.sys_tokens") + F.col("s.new_tokens") + F.col("s.before") - F.coalesce(F.try_element_at("earlier", F.lit(1))["before"], F.col("s.before"))
    return each.select(
        "conv_id",
        "window",
        F.array_join(F.transform(F.concat("system", "earlier", "new"), lambda x: x["piece"]), "").alias("formatted"),
        (F.size("earlier") + F.when(F.col("window") > 0, F.size("system")).otherwise(0)).alias("n_repeated"),
        (F.size("new") + F.when(F.col("window") == 0, F.size("system")).otherwise(0)).alias("n_new"),
        tokens.alias("n_tokens"),
        (tokens > budget).alias("over_budget"),
        F.transform(
            F.filter("new", lambda x: x["text_at"].isNotNull()),
            lambda x: F.struct(start(x).cast("bigint").alias("start"), (start(x) + x["text_chars"]).cast("bigint").alias("end")),
        ).alias("targets"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the samples' strings, repeats left out."""
    pieces = F.slice(F.split("formatted", CLOSE), F.col("n_repeated") + 1, F.col("n_new"))
    role = lambda p: unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), BETWEEN, 1))
    text = lambda p: unescape(F.substring(p, F.length(F.substring_index(p, BETWEEN, 1)) + 2, 1 << 30))
    turns = F.array_join(F.transform(pieces, lambda p: F.concat(role(p), F.lit("\n"), text(p), F.lit("\n"))), "")
    loss = F.array_join(F.transform("targets", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"]))), "")
    each = windows.select("conv_id", "window", "n_new", F.length("formatted").alias("chars"), turns.alias("turns"), loss.alias("loss"))
    ordered = each.groupBy("conv_id").agg(
        F.sum("n_new").cast("bigint").alias("n_turns"), F.sum("chars").cast("bigint").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w")
    )
    whole = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return ordered.select(
        "conv_id",
        "n_turns",
        F.sha2(whole("turns"), 256).alias("turns_sha256"),
        F.length(whole("loss")).cast("bigint").alias("loss_chars"),
        F.sha2(whole("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and -7 formatted in windows and read back: null texts are empty, repeated rows are turns of their own."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast(given.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(given.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return read_back(format_windows(given.unionByName(extra)))


OP9_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
a as (select *, 15 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + length(replace(replace(text, '\', '\b'), '<', '\l')) as chars,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, count(*) over (partition by conv_id) as n from c),
b as (select *, (chars + 3) // 4 as tokens, pos = 1 and role = 'system' and n > 1 as sys from a),
d as (select *, max(case when sys then tokens else 0 end) over (partition by conv_id) as sys_tokens,
    max(case when sys then chars else 0 end) over (partition by conv_id) as sys_chars,
    sum(case when sys then 0 else tokens end) over (partition by conv_id order by pos) - case when sys then 0 else tokens end as before,
    sum(case when sys then 0 else chars end) over (partition by conv_id order by pos) - case when sys then 0 else chars end as chars_before from b),
e as (select *, greatest(1, floor((768 - sys_tokens) / 2)) as room from d),
f as (select *, sys or tokens > room as alone from e),
g as (select *, (alone or coalesce(lag(alone) over (partition by conv_id order by pos), true))::int as change from f),
h as (select *, sum(change) over (partition by conv_id order by pos) as run from g),
i as (select *, floor((before - min(before) over (partition by conv_id, run)) / room) as slot,
    min(case when not sys then chars_before end) over (partition by conv_id order by before range between 256 preceding and current row) as since_chars from h),
s as (select conv_id, run, slot, arg_min(since_chars, pos) as since, max(chars_before + chars) as chars_end, any_value(sys_chars) as sys_chars
    from i where not sys group by conv_id, run, slot),
z as (select conv_id, sum(sys_chars + chars_end - since)::bigint as formatted_chars from s group by conv_id),
t as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
    coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '') as loss from a group by conv_id)
select t.conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from t join z on t.conv_id is not distinct from z.conv_id
"""
