"""Queries on small fixtures against brute force: no part of a text or table may stay unread."""

import re

from graphloom.plans import corpus_queries as Q


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def written(spark, tmp_path, name, values, schema):
    spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def words(text):
    return set(re.findall("[a-z0-9]+", text.lower()))


def test_edge_to_proposition_reads_all_edges_and_sentences(spark, tmp_path):
    long = "".join(f"Word{k} is the {k % 7} of {k}. " for k in range(60))
    texts = {1: long + "\nshort", 2: "the the the the. ....... ....... the.\n\nEnd", 3: None, 4: "", 5: "a b c d e f g" * 90}
    path = written(spark, tmp_path, "documents", [(k, t) for k, t in texts.items()], "doc_id bigint, text string")
    want, beyond, other = [], 0, 0
    for doc, text in texts.items():
        for para in filter(None, (text or "").split("\n")):
            sentences = re.findall(r"[^.!?]+[.!?]*\s*", para) or [para]
            n = (text or "").split("\n").index(para) + 1
            for start in range(0, len(para) - 6, 40):
                anchor = para[start : start + 7]
                for k, s in enumerate(sentences):
                    if words(anchor) <= words(s):
                        want.append((doc, f"p_{n}_s{k + 1}", anchor, f"d{start % 100}.json", f"/wiki/d{start % 100}"))
                        beyond += start >= 400
                        other += k % 4 > 0
    assert beyond and other
    assert rows(Q.edge_to_proposition(spark, path)) == sorted(want, key=str)


def test_document_scan_reads_all_lines(spark, tmp_path):
    texts = {1: "\n".join(f"line {k}" for k in range(40)), 2: "a\n\nb\nc\n", 3: None, 6: ""}
    path = written(spark, tmp_path, "documents", [(k, t, "en") for k, t in texts.items()], "doc_id bigint, text string, lang string")
    want = [(d, f"p_{k + 1}", "text", "top", line) for d, t in texts.items() for k, line in enumerate((t or "").split("\n"))]
    want += [(d, "i_1", "image", "top", "en") for d in texts if d % 3 == 0]
    assert rows(Q.document_scan(spark, path)) == sorted(want, key=str)


def test_decompose_questions_reads_whole_turns(spark, tmp_path):
    first = {1: "Tell me " + "of it and " * 40 + "mountains, rivers\nand harbours beyond glaciers", 2: "no word", 5: "done already", 7: "single?"}
    values = [(k, 0, "user", t) for k, t in first.items()] + [(1, 1, "assistant", "another turn")]
    path = written(spark, tmp_path, "conversations", values, "conv_id bigint, turn int, role string, text string")
    want = []
    for k, t in first.items():
        plain = re.sub("[^A-Za-z ]", " ", t)
        want += [(k, i, f"{k}___{i}", w) for i, w in enumerate(re.findall("[A-Za-z]{6,}", plain) or [plain]) if k % 5]
    assert rows(Q.decompose_questions(spark, path)) == sorted(want, key=str)


def test_baseline_pages_reads_all_lines(spark, tmp_path):
    lines = [(k, n, 10 * k + n) for k, most in ((1, 7), (2, 1), (3, 4)) for n in range(1, most + 1)]
    path = written(spark, tmp_path, "lineitem", lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint")
    got = {(r.qid, r.page, r["rank"]) for r in Q.baseline_pages(spark, path).collect()}
    assert got == {(k, f"doc_x_{part}", n) for k, n, part in lines}


def test_stream_reads_a_table_of_several_files(spark, data, tmp_path):
    from graphloom.plans import corpus_queries

    spark.read.parquet(f"{data}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    made = corpus_queries.stream_sentences(spark, str(tmp_path))
    want = corpus_queries.sentence_split(spark, str(tmp_path))
    assert made.count() == want.count() > 0 and made.exceptAll(want).isEmpty()
