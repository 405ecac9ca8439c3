"""The steps from parsed documents to a corpus of components, edges, lines and vectors, each a table that later steps and runs read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import Encoder, HashingEncoder, encode
from ..sources.sinks import exists, guarded
from . import corpus, serialize


@dataclass
class Parsed:
    """What parsing gave: paragraphs (doc, cid, title, section, text), links (doc, para, start, end, text, hyperlink), tables
    (doc, cid, title, section, cells, refs), images (doc, cid, title, section, text, ocr, summary, image), and what links mean, titles (url, title) and documents (title)."""

    paragraphs: DataFrame
    links: DataFrame
    tables: DataFrame
    images: DataFrame
    titles: DataFrame
    documents: DataFrame


def _links(parsed: Parsed, made: dict, needs_dereference: bool) -> DataFrame:
    if needs_dereference:
        return corpus.dereference(parsed.links, parsed.titles, parsed.documents)
    # Links of such a set name files already.
    return parsed.links.withColumn("edge", F.col("hyperlink"))


def _sentences(parsed: Parsed, made: dict, _) -> DataFrame:
    there = parsed.paragraphs.select("doc", "cid", "text")
    return corpus.located(corpus.sentences(there), there)


def _edges(parsed: Parsed, made: dict, _) -> DataFrame:
    below = corpus.edges_to_sentences(made["sentences"], made["links"].select("doc", "para", "start", "end", "text", "edge"))
    above = made["links"].select("doc", F.col("para").alias("cid"), "edge")
    return corpus.inter_edges(above.unionByName(below.select("doc", "cid", "edge")))


def _lines(parsed: Parsed, made: dict, _) -> DataFrame:
    named = parsed.paragraphs.select("doc", F.col("cid").alias("para"), "title", "section")
    low = made["sentences"].select("doc", "para", "cid", "text").join(named, ["doc", "para"]).select("doc", "cid", "title", "section", "text")
    texts = parsed.paragraphs.select("doc", "cid", "title", "section", "text").unionByName(low)
    return serialize.serialize_all(texts, parsed.tables.unionByName(made["segments"]), parsed.images, ("image",))


#: Each step's name and what makes its table of what was parsed and of the tables before it.
STEPS: dict[str, Callable[[Parsed, dict, bool], DataFrame]] = {
    "links": _links,
    "segments": lambda parsed, made, _: corpus.table_segments(parsed.tables),
    "sentences": _sentences,
    "edges": _edges,
    "lines": _lines,
    "vectors": None,
}


def build(
    spark: SparkSession, parsed: Parsed, out: str, steps: list[str] | None = None, needs_dereference: bool = True, overwrite: bool = False, encoder: Callable[[], Encoder] = HashingEncoder
) -> dict[str, DataFrame]:
    """The tables of all steps, or of those named and the ones before them in out; a step whose table is there is not run again unless overwrite.

    needs_dereference is the set's flag: links of sets without it name files already.  A step needs
    the tables of those before it; ValueError if one is missing, or unknown.
    """
    chosen = list(STEPS) if steps is None else steps
    unknown = [s for s in chosen if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(unknown)}; known are {', '.join(STEPS)}")
    made: dict[str, DataFrame] = {}
    for name, step in STEPS.items():
        path = f"{out}/{name}"
        if name in chosen and (overwrite or not exists(spark, path)):
            try:
                df = encode(made["lines"], encoder, "target", "images") if step is None else step(parsed, made, needs_dereference)
            except KeyError as e:
                raise ValueError(f"step {name} needs the table of step {e.args[0]}") from None
            guarded(df, path, force_overwrite=overwrite)
        if exists(spark, path):
            made[name] = spark.read.parquet(path)
    return made
