"""Substring dedup: suffix automata of reference shards, matched against documents for repeated runs of words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_values, id_type, mix64, utf8, width
from .words import Hasher, covered

WINDOW = 35  # words of a window
GRAM = 8  # words of an anchor
#: Levels of routing: how many neighbouring windows may share a key. The key is what all of them have in common, 36 words
#: less their number: the anchor at first, then 29 words around it, then the window itself.
RUNS = (WINDOW - GRAM + 1, 7, 1)
#: Unlike pieces of a key beyond which they are cut and dealt anew by the longer keys of the next level.
FULL = 100
#: Bits of each of the two filters of shared anchors that are broadcast: 16 MB, whatever the data.
FILTER_BITS = 1 << 27


class SuffixAutomaton:
    """All substrings of some sequences of hashable tokens, with how often each occurs.

    add() takes a sequence and its number of copies; no substring runs from
    one sequence into another.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.closed = False

    def add(self, tokens: Sequence, copies: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for t in tokens:
            q = nxt[last].get(t)
            if q is not None and length[q] == length[last] + 1:
                last = q
                count[q] += copies
                continue
            if q is not None:  # the prefix is known, but only as a suffix of longer ones
                clone = len(length)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[last] + 1)
                count.append(copies)
                link[q] = clone
                p = last
                while p >= 0 and nxt[p].get(t) == q:
                    nxt[p][t] = clone
                    p = link[p]
                last = clone
                continue
            cur = len(length)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(copies)
            p = last
            while p >= 0 and t not in nxt[p]:
                nxt[p][t] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][t]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(length)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    count.append(0)
                    link[q] = link[cur] = clone
                    while p >= 0 and nxt[p].get(t) == q:
                        nxt[p][t] = clone
                        p = link[p]
            last = cur

    def close(self) -> SuffixAutomaton:
        """Counts of prefixes become counts of all substrings."""
        if not self.closed:
            for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
                self.count[self.link[s]] += self.count[s]
            self.closed = True
        return self

    def matches(self, tokens: Sequence, least: int = 1) -> list[int]:
        """Matching statistics: for each place, the length of the longest run ending there that occurs least times or more."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        out, s, n = [], 0, 0
        for t in tokens:
            while s and t not in nxt[s]:
                s = link[s]
                n = length[s]
            if t in nxt[s]:
                s, n = nxt[s][t], n + 1
            while s and count[s] < least:
                s = link[s]
                n = length[s]
            out.append(n)
        return out


def anchors(hashes: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor, hash) of each segment of a document given by its words' hashes.

    The anchor of a window is the least hash of GRAM words in it, the leftmost
    of equals; a segment is a run of windows with their anchor at the same
    place.  So equal windows, in whatever documents, have equal anchors, and
    each window is in one segment.
    """
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    g = hasher.windows(hashes, GRAM)
    best, reach, size = np.arange(len(g)), 1, WINDOW - GRAM + 1
    while reach < size:
        step = min(reach, size - reach)
        left, right = best[:-step], best[step:]
        best = np.where(g[right] < g[left], right, left)
        reach += step
    starts = np.concatenate(([0], np.flatnonzero(best[1:] != best[:-1]) + 1))
    windows = np.diff(np.append(starts, n))
    up, down = hasher.word.get(len(hashes) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)))
    whole = (total[starts + windows + WINDOW - 1] - total[starts]) * down[starts]
    return starts, windows, g[best[starts]], whole + windows.astype(np.uint64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, h, doc_id, text): k and h together tell rows apart that differ in id or text."""
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(F.xxhash64(doc).alias("k"), F.xxhash64(doc, F.lit(1), text).alias("h"), doc.alias("doc_id"), text.alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shared_anchors(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two bit filters of FILTER_BITS: anchors that occur twice or more, and those of them in unlike segments.

    Anchors are counted over all texts with map-side combining; what comes to
    the driver is the filters' words, of bounded number.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        hasher = Hasher()
        for batch in batches:
            made = [anchors(hasher.words(utf8(t))[2], hasher)[2:] for t in column_values(batch.column(0), 64)]
            for at in range(0, len(made), 2000):
                a, w = (np.concatenate(z) for z in zip(*made[at : at + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([_signed(a), _signed(w)], names=["a", "w"])

    counted = rows.select("text").mapInArrow(run, "a bigint, w bigint").groupBy("a").agg(F.count("*").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"))
    words = FILTER_BITS // 64
    place, bit = F.col("a").bitwiseAND(F.lit(words - 1).cast("bigint")), F.expr("shiftleft(1L, cast(shiftrightunsigned(a, 58) as int))")
    bits = counted.where("n > 1").select(place.alias("p"), bit.alias("b"), F.when(F.col("lo") != F.col("hi"), bit).otherwise(F.lit(0).cast("bigint")).alias("u"))
    got = bits.groupBy("p").agg(F.bit_or("b").alias("b"), F.bit_or("u").alias("u")).toArrow()
    out = np.zeros((2, words), np.int64)
    p = got.column("p").to_numpy()
    out[0, p], out[1, p] = got.column("b").to_numpy(), got.column("u").to_numpy()
    return out[0].view(np.uint64), out[1].view(np.uint64)


def candidates(rows: DataFrame) -> DataFrame:
    """(k, h, start, windows, a, w, words) of the segments whose anchor may be shared; w tells segments of an anchor apart.

    words is a segment's text, if its anchor may be in unlike segments and the
    task hasn't given it lately: once at least for each (a, w) in need of it.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(shared_anchors(rows))
    names = ["k", "h", "start", "windows", "a", "w", "words"]

    def run(batches: Iterator[pa.RecordBatch]):
        hasher = Hasher()
        shared, unlike = held.value
        mask = np.uint64(len(shared) - 1)
        given: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols: list[list] = [[] for _ in names]
                ks, hs = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                for i, text in enumerate(column_values(part.column(2), 64)):
                    data = utf8(text)
                    first, last, hashes = hasher.words(data)
                    start, windows, a, w = anchors(hashes, hasher)
                    place, bit = (a & mask).astype(np.int64), a >> np.uint64(58)
                    hit = np.flatnonzero(shared[place] >> bit & np.uint64(1))
                    if not len(hit):
                        continue
                    start, windows, a, w = start[hit], windows[hit], a[hit].view(np.int64), w[hit].view(np.int64)
                    texts: list[bytes | None] = [None] * len(hit)
                    for j in np.flatnonzero(unlike[place[hit]] >> bit[hit] & np.uint64(1)).tolist():
                        pair = (int(a[j]), int(w[j]))
                        if pair not in given:
                            given.add(pair)
                            texts[j] = data[first[start[j]] : last[start[j] + windows[j] + WINDOW - 2]]
                    for c, x in zip(cols, (np.full(len(hit), ks[i]), np.full(len(hit), hs[i]), start, windows, a, w), strict=False):
                        c.append(x)
                    cols[6] += texts
                if len(given) > 300_000:
                    given.clear()
                if cols[0]:
                    arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in cols[:6]]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(cols[6], pa.binary())], names=names)

    return rows.select("k", "h", "text").mapInArrow(run, "k bigint, h bigint, start bigint, windows bigint, a bigint, w bigint, words binary")


def solve(group: list[tuple[int, bytes]]) -> list[int]:
    """For the segments (copies, words) of a shard, a mask of the windows that occur in another one or another copy."""
    sequences = [words.split() for _, words in group]
    automaton = SuffixAutomaton()
    for (copies, _), seq in zip(group, sequences, strict=True):
        automaton.add(seq, copies)
    automaton.close()
    found = [automaton.matches(seq, least=2)[WINDOW - 1 :] for seq in sequences]
    return [sum(1 << k for k, n in enumerate(f) if n >= WINDOW) for f in found]


def _automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, w, mask) of segments (a, w, copies, words) that come sorted by anchor."""
    group: list[tuple] = []
    out: list[tuple] = []

    def close() -> None:
        out.extend((r[0], r[1], m) for r, m in zip(group, solve([r[2:] for r in group]), strict=True) if m)
        group.clear()

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "w", "mask"])

    for batch in batches:
        for row in zip(*(column_values(c) for c in batch.columns), strict=True):
            if group and group[0][0] != row[0]:
                close()
                if len(out) > 5000:
                    yield batch_of()
                    out.clear()
            group.append(row)
    if group:
        close()
    if out:
        yield batch_of()


def _cut(run: int):
    """Cuts segments (a, w, copies, words) into pieces (pa, pw, lo, a, copies, words) of up to run windows that have the 36 - run words in common by which they are dealt.

    pa and pw name the segment, lo is the piece's first window in it, a the new key.  Which windows make up
    a piece depends on the distance from the anchor, so that equal windows have equal keys.
    """
    names = ["pa", "pw", "lo", "a", "copies", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                out: list[tuple] = []
                for a, w, copies, data in zip(*(column_values(c.slice(at, 2000)) for c in batch.columns), strict=True):
                    words = data.split()
                    hashes = hasher.words(data)[2]
                    anchor = int(np.argmin(hasher.windows(hashes, GRAM)))
                    cores = hasher.windows(hashes, WINDOW + 1 - run)
                    n = len(words) - WINDOW + 1
                    for block in range(max(0, anchor - n + 1) // run, anchor // run + 1):
                        low, high = max(0, anchor - (block + 1) * run + 1), min(n - 1, anchor - block * run)
                        key = int(mix64(cores[anchor - block * run : anchor - block * run + 1] + np.uint64(block))[0].view(np.int64))
                        out.append((a, w, low, key, copies, b" ".join(words[low : high + WINDOW])))
                if out:
                    *numbers, pieces = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(pieces, pa.binary())], names=names)

    return cut


def _masks(scratch: Scratch, segments: DataFrame, level: int = 0) -> DataFrame:
    """(a, w, mask) of the segments (a, w, copies, windows, words), which are unlike each other; bit i of mask: window i occurs in another one or another copy.

    Segments of a key make a reference shard: its automaton has to be matched with the
    shard's own segments only, as equal windows have equal keys.  A key of one kind of segment needs none.
    Shards of more than FULL segments are cut into pieces with longer keys, which part the segments
    that have no more than the key in common; like pieces are counted, and the shards they make are solved in the same way.
    """
    width_ = width(scratch.spark)
    stats = scratch.write(f"stats{level}", segments.groupBy("a").agg(F.count("*").alias("unlike"), F.sum("copies").alias("n")).where("n > 1"))
    stats = stats.select(F.col("a").alias("sa"), "unlike")
    shards = scratch.write(f"shards{level}", segments.join(stats, F.col("a") == F.col("sa")).drop("sa"))
    alike = shards.where("unlike = 1").select("a", "w", F.expr("shiftleft(1L, cast(windows as int)) - 1").alias("mask"))
    last = level + 1 == len(RUNS)
    own = shards.where("unlike > 1" if last else f"unlike between 2 and {FULL}").select("a", "w", "copies", "words")
    solved = own.repartition(width_, "a").sortWithinPartitions("a").mapInArrow(_automata, "a bigint, w bigint, mask bigint")
    out = alike.unionByName(solved)
    full = shards.where(f"unlike > {FULL}").select("a", "w", "copies", "words")
    if last or full.isEmpty():
        return scratch.write(f"masks{level}", out)
    made = full.repartition(width_).mapInArrow(_cut(RUNS[level + 1]), "pa bigint, pw bigint, lo bigint, a bigint, copies bigint, words binary")
    pieces = scratch.write(f"pieces{level}", made.withColumn("w", F.xxhash64("words")))
    counted = pieces.groupBy("a", "w", "words").agg(F.sum("copies").alias("copies"))
    windows = F.size(F.split(F.decode("words", "ISO-8859-1"), " ")) - F.lit(WINDOW - 1)
    found = _masks(scratch, scratch.write(f"segments{level + 1}", counted.withColumn("windows", windows)), level + 1)
    found = found.select(F.col("a").alias("sa"), F.col("w").alias("sw"), "mask")
    back = pieces.join(found, (F.col("a") == F.col("sa")) & (F.col("w") == F.col("sw")))
    back = back.groupBy("pa", "pw").agg(F.bit_or(F.expr("shiftleft(mask, cast(lo as int))")).alias("mask"))
    return scratch.write(f"masks{level}", out.unionByName(back.select(F.col("pa").alias("a"), F.col("pw").alias("w"), "mask")))


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(k, h, start, mask): bit i of mask says that the window from word start + i on starts somewhere else too.

    Like segments are counted first, by two hashes of 64 bits; unlike ones go to the automata of _masks().
    """
    scratch = Scratch(rows.sparkSession)
    found = scratch.write("found", candidates(rows))
    segments = scratch.write("segments", found.groupBy("a", "w").agg(F.count("*").alias("copies"), F.max("windows").alias("windows"), F.max("words").alias("words")))
    masks = _masks(scratch, segments).select(F.col("a").alias("sa"), F.col("w").alias("sw"), "mask")
    places = found.join(masks, (F.col("a") == F.col("sa")) & (F.col("w") == F.col("sw"))).select("k", "h", "start", "mask")
    out = scratch.write("places", places)
    scratch.keep_only("places")
    return out


def _places(start: Sequence[int], mask: Sequence[int]) -> np.ndarray:
    """Starts of repeated windows."""
    s, m = np.array(start, np.int64), np.array(mask, np.int64)
    bits = (m[:, None] >> np.arange(WINDOW - GRAM + 1)) & 1
    i, k = np.nonzero(bits)
    return s[i] + k


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs: its words outside of any window of 35 that starts elsewhere too.

    Windows are judged on the input, in all rows, the same one included; kept
    are the words left, joined by single spaces.  Null and empty texts have no
    words; a repeated row is another occurrence of each of its windows; rows
    without id are rows like others.  An empty table gives none.  Other
    columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col)
    found = repeated_windows(rows).groupBy("k", "h").agg(F.collect_list("start").alias("s"), F.collect_list("mask").alias("m"))
    found = found.select(F.col("k").alias("fk"), F.col("h").alias("fh"), "s", "m")
    both = rows.join(found, (F.col("k") == F.col("fk")) & (F.col("h") == F.col("fh")), "left").select("doc_id", "text", "s", "m")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, removed, kept = [], [], []
                for text, s, m in zip(*(column_values(part.column(c), 64) for c in (1, 2, 3)), strict=True):
                    words = utf8(text).split()
                    gone = covered(_places(s, m), WINDOW, len(words)) if s else None
                    left = words if gone is None else [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                    n.append(len(words))
                    removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, n_words bigint, n_removed bigint, kept string")


def _rounds(reference: DataFrame, window: int, shard_words: int, shards: int) -> Iterator[list[SuffixAutomaton]]:
    """Closed automata of the reference's texts, at most shards of them at once, each of shard_words words or a little more.

    Texts come to the driver one by one and are cut into slices that share window - 1 words, so that no window is lost.
    """
    step = max(1, shard_words - window + 1)
    made, held = [SuffixAutomaton()], 0
    for row in reference.select("text").distinct().toLocalIterator():
        words = utf8(row.text).split()
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + step + window - 1]
            if held and held + len(part) > shard_words:
                if len(made) == shards:
                    yield [a.close() for a in made]
                    made = []
                made.append(SuffixAutomaton())
                held = 0
            made[-1].add(part)
            held += len(part)
    if held:
        yield [a.close() for a in made]


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 100_000, shards: int = 4) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs: its words outside of any run of window words or more of a reference text.

    reference is a column text.  Its suffix automata, one for each shard of
    shard_words words, are broadcast, and documents are streamed for matching
    statistics.  What is broadcast at once is bounded by shards * shard_words words; a larger reference takes
    several rounds, between which the places found are written.  Null and empty texts have no words, on either side;
    repeated rows of docs give repeated rows, those of reference count once.  An
    empty reference removes nothing, an empty table gives none.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("binary").alias("gone"))
    schema = rows.schema
    for k, automata in enumerate(_rounds(reference, window, shard_words, shards)):
        if k:
            rows = scratch.write(f"round{k}", rows)
        rows = rows.mapInArrow(_marked([spark.sparkContext.broadcast(a) for a in automata], window), schema)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ns, removed, kept = [], [], []
            for text, bits in zip(column_values(batch.column(1), 64), column_values(batch.column(2), 64), strict=True):
                words = utf8(text).split()
                gone = _bits(bits, len(words))
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                ns.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            columns = [batch.column(0), pa.array(ns, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, n_words bigint, n_removed bigint, kept string")


def _bits(packed: bytes | None, n: int) -> np.ndarray:
    """n flags out of their bytes; none are set without bytes."""
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool) if packed else np.zeros(n, bool)


def _marked(automata: list, window: int):
    """Adds to gone, a bit for each word, the words in runs of window or more in any of the broadcast automata."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, marks = batch.slice(at, 256), []
                for text, bits in zip(column_values(part.column(1), 64), column_values(part.column(2), 64), strict=True):
                    words = utf8(text).split()
                    gone = _bits(bits, len(words))
                    for a in automata:
                        ends = np.array(a.value.matches(words), np.int64)
                        last = np.flatnonzero(ends >= window)
                        gone |= covered(last + 1 - window, window, len(words))
                    marks.append(np.packbits(gone).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(marks, pa.binary())], names=["doc_id", "text", "gone"])

    return run


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    """dedup() of all documents, with the hash of the words kept: null and empty texts have none of them, repeated rows are occurrences of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def substrings_reference(spark, sf_dir: str) -> DataFrame:
    """remove_reference() of all documents against the benchmark's texts, for windows of 13 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_reference(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), REFERENCE_WINDOW)


#: Words of a run of a reference text from which it is removed in substrings_reference.
REFERENCE_WINDOW = 13
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_STARTS = f"generate_series(1, len(w) - {REFERENCE_WINDOW - 1})"
REFERENCE_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select {_WORDS} as w from benchmark),
g as (select distinct list_slice(w, i, i + {REFERENCE_WINDOW - 1}) as gram from (select w, unnest({_STARTS}) as i from b)),
h as (select r, i from (select r, i, list_slice(w, i, i + {REFERENCE_WINDOW - 1}) as gram from (select r, w, unnest({_STARTS}) as i from d)) join g using (gram)),
gone as (select r, list(distinct i + j) as places from h cross join generate_series(0, {REFERENCE_WINDOW - 1}) as s(j) group by r),
k as (select doc_id, w, coalesce(places, []::bigint[]) as places from d left join gone using (r))
select doc_id, len(w) as n_words, len(places) as n_removed, array_to_string(list_filter(w, lambda x, i: not list_contains(places, i)), ' ') as kept from k
"""
