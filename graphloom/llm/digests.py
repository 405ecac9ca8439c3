"""Document fingerprints: digests of statistically improbable byte windows in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_values, id_type, whole_id, width

SPAN = 64  # bytes of a feature, and features that compete with each other
POPULAR = 16  # wins that a feature needs
BITS = 2048  # of a filter
FULL = 128  # features of a filter
HASHES = 5

_counts = np.arange(SPAN + 1)
#: -c log2 c in units of 1 / 4096 of a bit and window byte: entropies of windows add up as whole numbers.
_PART = np.concatenate(([0], np.rint(-_counts[1:] * np.log2(_counts[1:]) * 64))).astype(np.int64)
_ALL = int(SPAN * np.log2(SPAN) * 64)
#: Windows of less entropy, in bits, are no features.
LEAST = 2.0
#: Levels of entropy to either side that are counted together, so that the rank of a level doesn't hang on few windows.
NEAR = 32
_NONE = np.int64(1) << 20


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each level of entropy, lower for levels that fewer of the counted windows have; _NONE for those left out."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))
    at = np.arange(_ALL + 1)
    near = total[np.minimum(at + NEAR + 1, _ALL + 1)] - total[np.maximum(at - NEAR, 0)]
    rank = np.rint(np.log2(1.0 + near) * 10_000).astype(np.int64)
    rank[at < LEAST * 64 * SPAN] = _NONE
    return rank


def entropies(buf: np.ndarray) -> np.ndarray:
    """The entropy of the SPAN bytes from each place on, in units of 1 / (64 * SPAN) bits.

    One window differs from the next by a byte that leaves and one that
    comes; how often these occur in the window is counted for all places at once.
    """
    n = len(buf)
    ahead = np.ones(n, np.uint8)
    behind = np.ones(n, np.uint8)
    for d in range(1, SPAN):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    first = int(_PART[np.bincount(buf[:SPAN], minlength=256)].sum())
    leave = _PART[ahead[: n - SPAN] - 1] - _PART[ahead[: n - SPAN]]
    come = _PART[behind[SPAN:]] - _PART[behind[SPAN:] - 1]
    out = np.empty(n - SPAN + 1, np.int64)
    out[0] = first
    np.cumsum(leave + come, out=out[1:])
    out[1:] += first
    return out + _ALL


def _levels(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, level, own): texts one after the other with room between, the level of each window, and whether it lies within a text."""
    lengths = np.array([len(d) for d in datas], np.int64)
    begins = SPAN + np.cumsum(lengths) - lengths
    buf = np.frombuffer(bytes(SPAN) + b"".join(datas) + bytes(2 * SPAN), np.uint8)
    places = len(buf) - SPAN + 1
    # Windows that run over a text's end are no features: SPAN - 1 of them part any two texts' features.
    inside = np.zeros(places + 1, np.int64)
    has = lengths >= SPAN
    inside[begins[has]] += 1
    np.subtract.at(inside, begins[has] + lengths[has] - SPAN + 1, 1)
    return begins, lengths, entropies(buf), np.cumsum(inside[:places]) > 0


def measured(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """ranks() of the windows of all texts: how many of them have each level of entropy is counted in the tasks and added up.

    What comes to the driver is one number for each level, some 24,600, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_ALL + 1, np.int64)
        for batch in batches:
            texts = list(column_values(batch.column(0), 64))
            texts = [t or "" for t in texts]
            for at, size in _blocks(texts):
                _, _, level, own = _levels([t.encode("utf-8", "surrogatepass") for t in texts[at : at + size]])
                counts += np.bincount(level[own], minlength=_ALL + 1)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["level", "n"])

    made = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_ALL + 1, np.int64)
    counts[made.column("level").to_numpy()] = made.column("n").to_numpy()
    return ranks(counts)


def selected(datas: list[bytes], rank_of: np.ndarray) -> list[np.ndarray]:
    """The places of each text's selected features, in order.

    A feature is a window of SPAN bytes.  Of any SPAN features in a row (fewer
    at a text's ends) the one of lowest rank, the leftmost of equals, wins;
    features with POPULAR wins or more are selected.
    """
    begins, lengths, level, own = _levels(datas)
    places = len(level)
    rank = rank_of[level]
    rank[~own] = _NONE
    key = (rank << 40) | np.arange(places)
    best, reach = key, 1
    while reach < SPAN:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    wins = np.bincount(best & ((1 << 40) - 1), minlength=places)
    chosen = np.flatnonzero((wins >= POPULAR) & (rank < _NONE))
    cuts = np.searchsorted(chosen, begins)
    tops = np.searchsorted(chosen, begins + lengths)
    return [chosen[a:b] - s for a, b, s in zip(cuts.tolist(), tops.tolist(), begins.tolist(), strict=True)]


def filters(data: bytes, places: np.ndarray) -> np.ndarray:
    """The chained filters (k, BITS / 8) of a text: each takes FULL distinct features, then the next begins.

    A text without a selected feature has one feature, itself; an empty text
    has no filter.
    """
    if not data:
        return np.zeros((0, BITS // 8), np.uint8)
    digest = xxhash.xxh64_intdigest
    hashes = list(dict.fromkeys([digest(data[p : p + SPAN]) for p in places.tolist()])) or [digest(data)]
    h = np.array(hashes, np.uint64)
    which = np.repeat(np.arange(len(h)) // FULL, HASHES)
    bits = (h[:, None] >> (np.arange(HASHES, dtype=np.uint64) * np.uint64(11)) & np.uint64(BITS - 1)).astype(np.int64).ravel()
    out = np.zeros((which[-1] + 1, BITS), np.uint8)
    out[which, bits] = 1
    return np.packbits(out, axis=1)


def digests(datas: list[bytes], rank_of: np.ndarray) -> list[np.ndarray]:
    """The filters of each text, with features chosen by the ranks of their levels of entropy."""
    return [filters(d, p) for d, p in zip(datas, selected(datas, rank_of), strict=True)]


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all pairs of filters: bits in common beyond what chance gives, over the most that there could be beyond it."""
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    m, n = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    chance = m * n / BITS
    most = np.minimum(m, n)
    return np.clip((x @ y.T - chance) / np.maximum(most - chance, 1e-6), 0.0, 1.0)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean over the shorter chain's filters, by their bits, of the best normalised overlap in the other; 1 for equal chains."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    best = np.zeros(len(a))
    for k in range(0, len(b), 256):
        best = np.maximum(best, _overlap(a, b[k : k + 256]).max(axis=1))
    weight = np.unpackbits(a, axis=1).sum(axis=1)
    score = float((best * weight).sum() / weight.sum())
    return min(score, 1.0)


def written(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def edited(text: str, other: str) -> str:
    """text with its last floor(n / 2) characters replaced by as many of other's first, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _compare(rows: list[tuple], nexts: list[tuple], known: dict, rank_of: np.ndarray) -> list[tuple]:
    """Output columns of rows, given each one's next row; known has digests by text of rows that were next before."""
    texts = [r[-1] or "" for r in rows]
    others = [r[-1] or "" for r in nexts]
    changed = [edited(a, b) for a, b in zip(texts, others, strict=True)]
    need = [t for t in dict.fromkeys([*texts, *others, *changed]) if t not in known]
    for at, size in _blocks(need):
        known.update(zip(need[at : at + size], digests([t.encode("utf-8", "surrogatepass") for t in need[at : at + size]], rank_of), strict=True))
    out = []
    for t, o, c in zip(texts, others, changed, strict=True):
        own, new = known[t], known[c]
        sha = hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((len(t), sha, written(own), written(new), likeness(own, new), likeness(own, known[o])))
    return out


def _blocks(texts: list[str], size: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts with about size characters."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size or k + 1 == len(texts):
            yield start, k + 1 - start
            start, held = k + 1, 0


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, place, shown, doc_id, text), a partition for each bucket, sorted: the next row of a bucket is the next document.

    Ids are cut into ranges of about equally many rows, buckets, in descending
    order; rows without id follow, cut in the same way by a hash of their texts.  The first row of each bucket stands once more, not shown, at the end
    of the bucket before (of the last one, for the first).  So all texts move
    once and no order over the whole table is made in one task.  Rows of equal
    id are ordered by that hash.  Ids have to be whole numbers, else TypeError.
    """
    spark = docs.sparkSession
    whole_id(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("t", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    n = max(1, width(spark) - 1)
    cuts = lambda c: F.percentile_approx(c, [k / n for k in range(1, n)] or [0.5], 20 * n)
    found = rows.select(cuts("doc_id").alias("i"), cuts(F.when(F.col("doc_id").isNull(), F.col("t"))).alias("t"), F.bool_or(F.col("doc_id").isNull()).alias("some")).first()
    # Whole numbers, fewer than there are partitions.
    held = spark.sparkContext.broadcast([np.unique(np.array((m or [])[: n - 1], np.int64)) for m in (found.i, found.t)])

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series, t: pd.Series, there: pd.Series) -> pd.Series:
        marks, more = held.value
        by_id = len(marks) - np.searchsorted(marks, ids.to_numpy(np.int64), side="right")
        by_text = n + np.searchsorted(more, t.to_numpy(np.int64), side="right")
        return pd.Series(np.where(there.to_numpy(bool), by_id, by_text).astype(np.int32))

    rows = rows.withColumn("bucket", bucket_of(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.col("t"), F.col("doc_id").isNotNull()))
    heads = {r.bucket: (r.i, r.t) for r in rows.groupBy("bucket").agg(F.max(F.col("doc_id").cast("bigint")).alias("i"), F.min("t").alias("t")).collect()}
    order = sorted(heads)
    table = spark.createDataFrame([(b, *heads[b], order[k - 1]) for k, b in enumerate(order)], "b int, i bigint, tie bigint, to int")
    own = rows.withColumn("place", F.lit(0)).withColumn("shown", F.lit(True))
    # The table has a row for each bucket, at most twice as many as partitions.
    first = (F.col("doc_id") == F.col("i")) | (F.col("doc_id").isNull() & (F.col("t") == F.col("tie")))
    again = rows.join(F.broadcast(table), (F.col("bucket") == F.col("b")) & first)
    again = again.select("doc_id", "text", F.col("to").alias("bucket"), "t", F.lit(1).alias("place"), F.lit(False).alias("shown"))
    return (
        own.unionByName(again)
        .repartitionById(2 * n if found.some else n, "bucket")
        .sortWithinPartitions("bucket", "place", F.desc_nulls_last("doc_id"), "t")
        .select("bucket", "place", "shown", "doc_id", "text")
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_of: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs.

    Features are ranked by how rare their entropy is among all windows of docs, or by rank_of, as measured() gave it
    for another corpus.  The edited text's second half comes from the next document, by descending
    id; the last one's from the first.  Null texts count as empty; an empty
    text's fingerprint is the empty string, like only to itself.  Rows that
    repeat an id follow each other in an order given by their texts; rows without id
    come last, by a hash of their texts; other ids are whole numbers, else TypeError.  A table of one row is its own next, an empty one gives none.
    Other columns are ignored.
    """

    shared = docs.sparkSession.sparkContext.broadcast(measured(docs, text_col) if rank_of is None else rank_of)

    def run(batches: Iterator[pa.RecordBatch]):
        waiting: tuple | None = None
        pairs: list[tuple[tuple, tuple]] = []
        known: dict = {}
        held = 0

        def flush():
            nonlocal known, held
            last = pairs[-1][1][-1] or ""
            made = _compare([p[0] for p in pairs], [p[1] for p in pairs], known, shared.value)
            known, held = {last: known[last]}, 0
            ids = pa.array([p[0][1] for p in pairs], kind)
            pairs.clear()
            cols = list(zip(*made, strict=True))
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)

        for batch in batches:
            kind = batch.schema.field(3).type
            for bucket, place, shown, doc, text in zip(*(column_values(batch.column(k), 64) for k in range(5)), strict=True):
                if waiting is not None and waiting[0] == bucket and (shown or place == 1):
                    pairs.append((waiting, (bucket, doc, text)))
                    held += len(waiting[2] or "") + 200
                    waiting = None
                if shown:
                    waiting = (bucket, doc, text)
                if held > 1 << 20:
                    yield flush()
        if pairs:
            yield flush()

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"doc_id {id_type(docs, id_col)}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """fingerprint_edits() of all documents: null texts count as empty, repeated rows follow each other."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
