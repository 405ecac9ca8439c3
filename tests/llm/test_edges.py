"""All operators and stages on odd tables: nulls in every column, empty and very long texts, repeated rows, clashing columns, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import chat, digests, langid, mixing, pieces, quality, secrets, simhash, substrings, urls

LONG = "Lorem ipsum dolor sit amet " * 30_000
CLASH = ["id", "fp", "node", "k", "h", "bucket", "t", "place", "shown", "doc", "others", "head", "times", "n_words", "copy", "n_copies", "size", "grp", "u", "g", "rate", "cdf", "score", "lang_pred", "kept", "component_id", "shuffle_key", "a", "b", "w", "pieces", "spans", "text_", "a.b"]
ROWS = [
    (1, "the cat and the dog and the bird of the house", "en", "src0", 45),
    (1, "the cat and the dog and the bird of the house", "en", "src0", 45),
    (2, "", "en", "src1", 0),
    (3, None, None, None, None),
    (None, "password = 'hunter2hunter2' und der die das ist nicht", "de", "src0", None),
    (None, None, None, None, None),
    (4, LONG, "de", "src9", len(LONG)),
    (5, "a\x00b ퟿ 😀   é", None, "", -1),
    (6, " \n\t ", "en", None, 4),
    (-7, "x", "", "src2", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH]).repartition(3)


OPERATORS = {
    "simhash": simhash.simhash_components,
    "quality": quality.ledger,
    "digests": digests.fingerprint_edits,
    "substrings": substrings.dedup,
    "langid": lambda d: langid.identify(d, model=langid.fit(d, steps=20)),
    "secrets": lambda d: secrets.scan_documents(d, redacted=True),
    "redact": secrets.redact_column,
    "urls": lambda d: urls.judge(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, name):
    made = OPERATORS[name](docs)
    assert made.count() == len(ROWS)
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_pieces(docs):
    made = pieces.encode(docs)
    assert made.count() == len(ROWS) and pieces.encode(docs.limit(0)).count() == 0


def test_mixing(docs):
    made = mixing.mix(docs, mixing.WEIGHTS, mixing.OTHER, epochs=30.0)
    own = made.select("doc.*")
    assert own.columns == docs.columns and own.where("doc_id is null").count() > 0
    assert mixing.mix(docs.limit(0), mixing.WEIGHTS, mixing.OTHER).count() == 0


def test_chat(spark, docs):
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("source").alias("role"), "text", "window_" if "window_" in docs.columns else F.lit(1).alias("window"), F.lit(2).alias("t"))
    back = chat.read_back(chat.format_windows(turns, target_role="src0")).collect()
    assert sum(r.n_turns for r in back) == len(ROWS)
    assert {r.conv_id: r.loss_chars for r in back}[1] == 2 * len(ROWS[0][1])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    made = stage(spark, docs, "nowhere")
    rows = made.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert made.columns == docs.columns
    if name == "near_dedup":
        assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "4", "5", "-7", "None", "None"])
    elif name in ("secret_scan", "piece_encoding"):
        assert len(rows) == len(ROWS)
    assert stage(spark, docs.limit(0), "nowhere").count() == 0
