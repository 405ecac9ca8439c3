"""SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_type, map_rows, utf8, whole_id, width
from .components import connected_components

TILE = 1024
#: Fingerprints of a group that one task compares; larger groups are dealt out in pairs of chunks of this size.
GROUP = 16384


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits of a text, unsigned: bit i is set if it is set in over half of the shingles' XXH64 values.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of
    fewer words than a shingle has is one shingle, a text of none gives 0.
    """
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    a, b = starts[:n].tolist(), ends[-n:].tolist()
    counts, step = np.zeros(64, np.int64), 1 << 15
    for k in range(0, n, step):
        h = np.array([digest(joined[i:j], 42) for i, j in zip(a[k : k + step], b[k : k + step], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every text; null counts as empty."""

    def rows():
        def one(text):
            x = fingerprint(text, shingle)
            return (x - (1 << 64) if x >> 63 else x,)

        return one

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(kept, f"id {id_type(docs, id_col)}, fp bigint", [("fp", pa.int64())], rows, ["id"])


def block_masks(n: int, radius: int, tile: int = 256) -> list[int]:
    """Bit masks such that fingerprints within radius agree under one of them at least.

    The 64 bits are cut into blocks; radius differing bits spoil radius blocks
    at most, so any two such fingerprints agree on some choice of the others.
    There are as many blocks as leave tile fingerprints or fewer, evenly
    spread, under one value of a mask.
    """
    for blocks in range(radius + 1, 3 * radius + 2):
        if n <= tile << (64 * (blocks - radius) // blocks):
            break
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def tile_components(x: np.ndarray, radius: int) -> np.ndarray:
    """For each of the fingerprints x, the least position that it reaches by links of at most radius bits.

    A fingerprint is a word of 64 bits, or a row of them.  Fingerprints are laid out in tiles by population count; tiles whose counts
    differ beyond the radius are skipped, others are compared whole.
    """
    parent = list(range(len(x)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    x = x.reshape(len(x), -1)
    pop = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    order = np.argsort(pop, kind="stable")
    x, pop = x[order], pop[order]
    for i in range(0, len(x), TILE):
        left = x[i : i + TILE]
        top = pop[min(i + TILE, len(x)) - 1] + radius
        for j in range(i, len(x), TILE):
            if pop[j] > top:
                break
            right = x[j : j + TILE]
            apart = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0])
            for word in range(1, x.shape[1]):
                apart += np.bitwise_count(left[:, None, word] ^ right[None, :, word])
            near = apart <= radius
            if i == j:
                near &= np.tri(len(left), k=-1, dtype=bool).T
            found = np.count_nonzero(near)
            if not found:
                continue
            if found <= 8 * TILE:
                for p, q in zip(*(z.tolist() for z in np.nonzero(near)), strict=True):
                    union(int(order[i + p]), int(order[j + q]))
                continue
            a = np.array([find(k) for k in order[i : i + TILE].tolist()])
            b = np.array([find(k) for k in order[j : j + TILE].tolist()])
            if i == j:
                near |= near.T
            while True:
                a2 = np.minimum(a, np.where(near, b[None, :], len(parent)).min(axis=1))
                b2 = np.minimum(b, np.where(near, a2[:, None], len(parent)).min(axis=0))
                if (a2 == a).all() and (b2 == b).all():
                    break
                for old, new in ((a, a2), (b, b2)):
                    for p, q in {*zip(old.tolist(), new.tolist(), strict=True)}:
                        union(p, q)
                a, b = a2, b2
    return np.array([find(k) for k in range(len(parent))], dtype=np.int64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fp, node) of each run of equal (mask, value); rows come sorted by these."""
    rest: list[np.ndarray] = []
    for batch in batches:
        m, v, fp, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if rest:
            m, v, fp, node = (np.concatenate(z) for z in zip(rest, (m, v, fp, node), strict=True))
        new = np.flatnonzero((m[1:] != m[:-1]) | (v[1:] != v[:-1])) + 1
        bounds = np.concatenate(([0], new))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                yield fp[a:b], node[a:b]
        last = bounds[-1] if len(bounds) else 0
        rest = [m[last:], v[last:], fp[last:], node[last:]]
    if rest and len(rest[0]) > 1:
        yield rest[2], rest[3]


def _chunk_pairs(dealt: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of hot groups (mask, value, n), a copy for each pair of chunks that a fingerprint's own chunk is in.

    A chunk holds about GROUP fingerprints, whatever the group's size; the pair's number stands for the mask.
    """
    h = hot.select(F.col("mask").alias("hm"), F.col("value").alias("hv"), F.ceil(F.col("n") / GROUP).cast("bigint").alias("chunks"))
    rows = dealt.join(h, (F.col("mask") == F.col("hm")) & (F.col("value") == F.col("hv")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    rows = rows.select("mask", "value", "fp", "node", "own", "chunks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("other"))
    pair = (F.col("mask") * F.col("chunks") + F.least("own", "other")) * F.col("chunks") + F.greatest("own", "other")
    return rows.select(pair.alias("mask"), "value", "fp", "node")


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): links of nodes that make up the same components as all pairs within radius bits.

    distinct has (fp, node), each fp once.  Every fingerprint goes to the group
    of each of its masked values; a group is compared in tiles and gives one
    link for each fingerprint at most, to the least node that it reaches.  A
    group of more than GROUP fingerprints is compared whole too, as all pairs of its chunks, which
    tasks share.
    """
    spark = distinct.sparkSession
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(m) for m in block_masks(distinct.count(), radius)]
    dealt = distinct.select(
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "value"), "fp", "node"
    )

    def run(batches):
        for fp, node in _groups(batches):
            order = np.argsort(node, kind="stable")
            fp, node = fp[order], node[order]
            least = tile_components(fp.view(np.uint64), radius)
            moved = np.flatnonzero(least != np.arange(len(least)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[least[moved]])], names=["a", "b"])

    def compared(rows: DataFrame) -> DataFrame:
        return rows.repartition(width(spark), "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(run, "a bigint, b bigint")

    hot = cut(dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > GROUP))
    if hot.isEmpty():
        return compared(dealt)
    group = [F.col("mask") == F.col("hm"), F.col("value") == F.col("hv")]
    cold = dealt.join(hot.select(F.col("mask").alias("hm"), F.col("value").alias("hv")), group, "left_anti")
    pairs = _chunk_pairs(dealt.withColumn("mask", F.col("mask").cast("bigint")), hot)
    return compared(cold).unionByName(compared(pairs))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Fingerprints within radius bits link, equal ones included; component_id is
    the smallest id reachable.  Null texts count as empty; texts without a word
    have fingerprint zero and link like others.  Repeated rows give repeated
    rows.  A row without id has component_id null unless its fingerprint is
    that of a row with one, and links no others.  An empty table gives none.
    Ids are whole numbers, else TypeError.  Other columns are ignored, whatever their names.
    """
    whole_id(docs, id_col)
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(fps.where("id is not null").groupBy("fp").agg(F.min(F.col("id").cast("bigint")).alias("node")))
    found = connected_components(near_links(distinct, radius), "a", "b")
    named = distinct.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        F.col("fp").alias("f"), F.coalesce("component", "node").alias("component_id")
    )
    return fps.join(cut(named), F.col("fp") == F.col("f"), "left").select(F.col("id").alias("doc_id"), "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """simhash_components() of all documents: null and empty texts have fingerprint zero and link, repeated rows give repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_components(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
