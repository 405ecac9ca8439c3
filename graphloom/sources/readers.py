"""Files that a corpus and its questions come in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import QA_SCHEMAS

IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "gif")


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A .jsonl file, a row each line, or a .json file, a row for each of its array's values or one; other endings are an error."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".jsonl"):
        return reader.json(path)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    raise ValueError(f"{path!r} ends neither in .json nor in .jsonl")


def read_documents(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All .json files of a folder, a document each, with file, their name; a missing key is null."""
    docs = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return docs.withColumn("file", F.substring_index(F.col("_metadata.file_path"), "/", -1))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, length, content) of image files below a folder, by their ending.  Unread columns are not loaded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    return files.where(ending.isin(*IMAGES)).select(F.substring_index("path", "/", -1).alias("name"), "path", "length", "content")


def readable(content: Column) -> Column:
    """Whether bytes start as a PNG, JPEG, GIF, BMP or WebP file does."""
    head = F.hex(F.substring(content, 1, 12))
    fits = [head.startswith(x) for x in ("89504E470D0A1A0A", "FFD8FF", "47494638", "424D")]
    out = head.rlike("^52494646.{8}57454250")
    for f in fits:
        out = out | f
    return F.coalesce(out, F.lit(False))


def page_targets(images: DataFrame) -> DataFrame:
    """(file, target, images) for encoding whole pages: an empty text and the page's image, readable ones only."""
    return images.where(readable(F.col("content"))).select(F.col("name").alias("file"), F.lit("").alias("target"), F.array("path").alias("images"))


def parse_yaml(text: str, root: str) -> dict:
    """YAML with ${REPO_ROOT} replaced in all of its strings."""
    import yaml

    def put(x):
        if isinstance(x, dict):
            return {k: put(v) for k, v in x.items()}
        if isinstance(x, list):
            return [put(v) for v in x]
        return re.sub(r"\$\{REPO_ROOT\}", lambda _: root, x) if isinstance(x, str) else x

    return put(yaml.safe_load(text))


def read_yaml(path: str, root: str) -> dict:
    """A YAML file that the driver sees; settings only."""
    with open(path, encoding="utf-8") as f:
        return parse_yaml(f.read(), root)


def embedding_shards(parts: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(doc, cid, vec) of shards, each a table (row, vec) and a map (row, doc, cid); rows keep their keys, so that no offsets are needed."""
    shards = [vectors.join(names, "row").select("doc", "cid", "vec") for vectors, names in parts]
    out = shards[0]
    for more in shards[1:]:
        out = out.unionByName(more)
    return out


def checked_shards(parts: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """embedding_shards(), after a check that each shard has as many vectors as names; ValueError if one hasn't."""
    sizes = None
    for k, (vectors, names) in enumerate(parts):
        n = vectors.agg(F.lit(k).alias("shard"), F.count("*").alias("vectors")).join(names.agg(F.lit(k).alias("shard"), F.count("*").alias("names")), "shard")
        sizes = n if sizes is None else sizes.unionByName(n)
    odd = sizes.where("vectors <> names").orderBy("shard").collect()
    if odd:
        raise ValueError("; ".join(f"shard {r.shard} has {r.vectors} vectors and {r.names} names" for r in odd))
    return embedding_shards(parts)


def merged_lines(shards: list[DataFrame], line_col: str = "line") -> DataFrame:
    """Lines of several writers as one file's: those of each shard behind those of the ones before, with line counted through.

    A shard's lines are counted from 0 without gaps; the offsets are one number for each shard.
    """
    out, first = None, 0
    for part in shards:
        moved = part.withColumn(line_col, F.col(line_col).cast("bigint") + F.lit(first))
        first += part.count()
        out = moved if out is None else out.unionByName(moved)
    return out


def inverted(index: DataFrame, key: str, value: str) -> DataFrame:
    """(value, key): an index read the other way; of keys with one value, the smallest."""
    return index.groupBy(value).agg(F.min(key).alias(key))


def _items(df: DataFrame, field: str) -> list[str]:
    kind = df.schema[field].dataType
    return kind.elementType.fieldNames() if hasattr(kind, "elementType") and hasattr(kind.elementType, "fieldNames") else []


def _labeled(raw: DataFrame, evidence) -> DataFrame:
    there = set(_items(raw, "evidences"))
    pick = lambda e, name: e[name].cast("string") if name in there else F.lit(None).cast("string")
    return raw.select(
        F.col("qid").cast("string").alias("qid"),
        "question",
        F.transform("answers", lambda a: a["answer"].cast("string")).alias("answers"),
        F.transform("evidences", lambda e: F.struct(*[c.alias(n) for n, c in zip(("modality", "doc", "cid", "score"), evidence(e, pick), strict=True)])).alias("evidences"),
    )


def _without(text: Column, *endings: str) -> Column:
    for x in endings:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


@QA_SCHEMAS.register("vqa_evidence")
def vqa_evidence(raw: DataFrame) -> DataFrame:
    """Page questions: the evidence is an image, its name without ending the document."""
    none = F.lit(None).cast("string")
    return _labeled(raw, lambda e, pick: (none, _without(pick(e, "gold_image"), ".jpeg", ".jpg", ".png"), none, none.cast("double")))


@QA_SCHEMAS.register("mmqa_component")
def mmqa_component(raw: DataFrame) -> DataFrame:
    """Web questions with components as evidence; what a record lacks is null."""
    return _labeled(raw, lambda e, pick: (pick(e, "mmqa_doc_modality"), pick(e, "gold_webpage_title"), pick(e, "gold_component_id"), pick(e, "gold_component_score").cast("double")))


@QA_SCHEMAS.register("mmqa_page")
def mmqa_page(raw: DataFrame) -> DataFrame:
    """Web questions with pages of PDF files as evidence."""
    return _labeled(raw, lambda e, pick: (pick(e, "mmqa_doc_modality"), pick(e, "gold_pdf_name"), _without(pick(e, "gold_page"), ".png"), pick(e, "gold_page_score").cast("double")))


def parse_questions(raw: DataFrame, schema: str) -> DataFrame:
    """(qid, question, answers, evidences) by the name of a registered schema."""
    return QA_SCHEMAS.get(schema)(raw)


def latest_answers(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """(qid, answers): of answers to one question, that of the last line."""
    return lines.groupBy("qid").agg(F.max_by("answers", line_col).alias("answers"))


def optional_table(spark: SparkSession, *paths: str) -> list[DataFrame] | None:
    """Parquet tables at all of paths, or None if one of them isn't there."""
    from .sinks import exists

    return [spark.read.parquet(p) for p in paths] if all(exists(spark, p) for p in paths) else None
