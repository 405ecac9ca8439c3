"""New documents as a stream: each batch's sentences and links go to tables, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, cid, text): the lines of a text as paragraphs p_<i>, empty ones left out but counted."""
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("k", "text"))
    return lines.where("text <> ''").select("doc", F.concat(F.lit("p_"), F.col("k") + 1).alias("cid"), "text")


def ingest(spark: SparkSession, folder: str, schema, out: str, pattern: str = "*.parquet", id_col: str = "doc_id", text_col: str = "text", trigger: dict | None = None):
    """A running query that reads Parquet files as they come to a folder and adds their sentences to <out>/sentences.

    Batches are stateless.  A batch that is run again after a failure writes
    over what it wrote before: its rows carry its number and go to a folder of
    that number, so each document's sentences are there once.
    """

    def add(batch: DataFrame, number: int) -> None:
        made = corpus.sentences(paragraphs(batch, id_col, text_col))
        made.write.mode("overwrite").parquet(f"{out}/sentences/batch={number}")

    docs = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return docs.select(id_col, text_col).writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/state").trigger(**(trigger or {"availableNow": True})).start()
