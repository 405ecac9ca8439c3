"""Edges of the component graph as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intra_edges(components: DataFrame) -> DataFrame:
    """(doc, top, cid, other): ordered pairs of components of one upper component, given (doc, top, cid).

    The pairs are the result: as many as components in a document's paragraph, table or image squared.
    """
    other = components.select(F.col("doc").alias("d"), F.col("top").alias("t"), F.col("cid").alias("other"))
    return components.join(other, (F.col("doc") == F.col("d")) & (F.col("top") == F.col("t"))).where("cid <> other").select("doc", "top", "cid", "other")


def children(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, top, cid): what lies below each upper component; of a paragraph, sentences only."""
    below = edges.where(F.col("cid") == F.col("top")).select("doc", "top", F.col("other").alias("cid"))
    return below.where(~F.col("top").startswith("p") | (F.instr("cid", "s") > 0))


def low_neighbours(low: DataFrame, links: DataFrame) -> DataFrame:
    """(node, near): all other components of the same document, and those of all documents that the component's parent links to; low has (node, top, doc)."""
    other = low.select(F.col("node").alias("near"), F.col("doc").alias("near_doc"))
    same = low.join(other, F.col("doc") == F.col("near_doc")).where("node <> near").select("node", "near")
    target = links.select(F.col("top").alias("t"), "dst").distinct()
    out = low.join(target, F.col("top") == F.col("t")).join(other, F.col("dst") == F.col("near_doc")).select("node", "near")
    return same.unionByName(out).distinct()
