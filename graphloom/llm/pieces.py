"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, many words at once."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_values, id_type, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNIGRAM = 1
_CHUNK = 1 << 20
_STOP = 255  # between words; no byte of UTF-8


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + n]
        at += n


def read_model(data: bytes) -> tuple[list[bytes], list[float], list[int], int]:
    """Pieces, scores, types and the kind of model that a SentencePiece model file holds."""
    pieces, scores, types, kind = [], [], [], UNIGRAM
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append(f.get(1, b""))
            scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            types.append(f.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
    return pieces, scores, types, kind


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie: node s has a child t = base[s] + byte if check[t] == s; value[t] is -1 inside keys only."""
    root: dict = {}
    for key, v in zip(keys, values, strict=True):
        node = root
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = v
    size = 1 << 10
    used = bytearray(size)
    base, check, value = [0] * size, [-1] * size, [-1] * size
    used[0] = 1
    queue, free = [(0, root)], 1
    for s, node in queue:
        value[s] = node.get(-1, -1)
        below = sorted(b for b in node if b >= 0)
        if not below:
            continue
        at = free
        while True:
            at = used.find(0, at)
            if at < 0 or at + 512 > size:
                grow = size
                used += bytes(grow)
                base += [0] * grow
                check += [-1] * grow
                value += [-1] * grow
                size += grow
                at = max(at, free) if at >= 0 else used.find(0, free)
            b0 = at - below[0]
            if b0 > 0 and not any(used[b0 + b] for b in below):
                break
            at += 1
        base[s] = b0
        for b in below:
            used[b0 + b] = 1
            check[b0 + b] = s
            queue.append((b0 + b, node[b]))
        if len(below) > 8:  # what few free places lie before are too tight
            free = max(free, at - 256)
        while used[free]:
            free += 1
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


class Pieces:
    """An encoder and decoder; plain arrays, so that it can be broadcast.

    A unigram model's own scores are used.  A BPE model has no probabilities:
    its pieces get the log probability of Zipf's law at their rank, which
    is their order in the file.  Spaces are written as whitespace markers, with one
    before the text; characters without a piece fall back to their bytes.
    """

    def __init__(self, data: bytes):
        pieces, scores, types, kind = read_model(data)
        self.size = len(pieces)
        self.unknown = types.index(UNKNOWN) if UNKNOWN in types else 0
        own = [k for k, t in enumerate(types) if t in (NORMAL, USER_DEFINED) and pieces[k]]
        if kind != UNIGRAM:
            whole = math.log(sum(1 / (k + 1) for k in range(len(own))))
            for rank, k in enumerate(own):
                scores[k] = -math.log(rank + 1) - whole
        self.scores = np.zeros(self.size + 1)
        self.scores[: self.size] = scores
        self.scores[self.size] = min(scores[k] for k in own) - 10.0  # of a character without a piece
        surface = [b""] * self.size
        for k in own:
            surface[k] = pieces[k].replace("▁".encode(), b" ")
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for k, t in enumerate(types):
            if t == BYTE:
                surface[k] = bytes([int(pieces[k][3:5], 16)])
                self.byte_ids[surface[k][0]] = k
        self.lengths = np.array([len(x) for x in surface], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.base, self.check, self.value = double_array([surface[k] for k in own], own)
        # A piece has spaces at its start only, and none has a line end: words can be encoded one by one.
        self.by_word = not any(b" " in surface[k].lstrip(b" ") or (b"\n" in surface[k]) for k in own)

    def edges(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every piece in buf, and of each character without one, as id size."""
        starts = np.flatnonzero(((buf & 0xC0) != 0x80) & (buf != _STOP))
        width = np.where(buf[starts] < 0x80, 1, np.where(buf[starts] < 0xE0, 2, np.where(buf[starts] < 0xF0, 3, 4)))
        at, node, s, e, v = starts, np.zeros(len(starts), np.int32), [], [], []
        first = np.arange(len(starts))
        single = np.zeros(len(starts), bool)
        depth = 0
        while len(at):
            t = self.base[node] + buf[at + depth]
            ok = self.check[t] == node
            at, node, first = at[ok], t[ok], first[ok]
            depth += 1
            ids = self.value[node]
            hit = ids >= 0
            if hit.any():
                s.append(at[hit])
                e.append(at[hit] + depth)
                v.append(ids[hit])
                single[first[hit][width[first[hit]] == depth]] = True
        lone = starts[~single]
        s.append(lone)
        e.append(lone + width[~single])
        v.append(np.full(len(lone), self.size, np.int32))
        return np.concatenate(s), np.concatenate(e), np.concatenate(v)

    def viterbi(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each.

        All words advance together, one byte position a step; of equal paths
        the one with the longest last piece wins.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths + 1) - lengths - 1
        buf = np.frombuffer(bytes([_STOP]).join(words) + bytes([_STOP] * 2), np.uint8)
        s, e, v = self.edges(buf)
        unit = np.zeros(len(buf), np.int64)
        unit[begins[1:]] = 1
        offset = s - begins[np.cumsum(unit)[s]]
        order = np.argsort(offset, kind="stable")
        s, e, v = s[order], e[order], v[order]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(offset)))).tolist()
        gain = self.scores[v]
        best = np.full(len(buf), -np.inf)
        best[begins] = 0.0
        back = np.full(len(buf), -1, np.int64)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            ends = e[a:b]
            score = best[s[a:b]] + gain[a:b]
            better = np.flatnonzero(score > best[ends])
            best[ends[better]] = score[better]
            back[ends[better]] = a + better
        at, live = begins + lengths, np.flatnonzero(lengths)
        taken_w, taken_v = [], []
        while len(live):
            edge = back[at[live]]
            at[live] = s[edge]
            taken_w.append(live)
            taken_v.append(edge)
            live = live[at[live] > begins[live]]
        if not taken_w:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        w, edge = np.concatenate(taken_w[::-1]), np.concatenate(taken_v[::-1])
        order = np.argsort(w, kind="stable")
        w, edge = w[order], edge[order]
        ids, n = v[edge], np.bincount(w, minlength=len(words))
        if (lone := np.flatnonzero(ids == self.size)).size:
            spread = np.ones(len(ids), np.int64)
            spread[lone] = (e - s)[edge[lone]]
            out = np.repeat(ids, spread)
            places = np.flatnonzero(out == self.size)
            first = (np.cumsum(spread) - spread)[lone]
            source = np.repeat(s[edge[lone]] - first, spread[lone]) + places
            out[places] = self.byte_ids[buf[source]]
            n = np.bincount(np.repeat(w, spread), minlength=len(words))
            ids = out
        return ids, n

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8: pieces and bytes joined, without the space that encoding puts before a text."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - n), n)
        out = self.bytes[places].tobytes()
        return out[1:] if out[:1] == b" " else out


class Encoder:
    """Encodes texts word by word, remembering up to limit words."""

    def __init__(self, pieces: Pieces, limit: int = 200_000):
        self.pieces, self.limit = pieces, limit
        self.split = re.compile(rb" +[^ \n]*|[^ \n]+|\n").findall if pieces.by_word else lambda data: [data]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at, self.n, self.total = [], [], [], 0
        self.flat = None

    def _learn(self, words: list[bytes]) -> None:
        chunk, size = [], 0
        for k, word in enumerate(words):
            chunk.append(word)
            size += len(word)
            if size >= _CHUNK or k + 1 == len(words):
                ids, n = self.pieces.viterbi(chunk)
                self.ids.append(ids)
                self.at.append(self.total + np.cumsum(n) - n)
                self.n.append(n)
                self.total += len(ids)
                chunk, size = [], 0
        self.flat = None

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        if len(self.known) > self.limit:
            self.forget()
        known, news, places = self.known, [], []
        for text in texts:
            row = []
            for word in self.split(b" " + text) if text else ():
                k = known.get(word)
                if k is None:
                    k = known[word] = len(known)
                    news.append(word)
                row.append(k)
            places.append(np.array(row, np.int64))
        if news:
            self._learn(news)
        if self.flat is None:
            self.flat = [np.concatenate(z) if z else np.zeros(0, np.int64) for z in (self.ids, self.at, self.n)]
            self.ids, self.at, self.n = ([z] for z in self.flat)
        ids, at, n = self.flat
        out = []
        for row in places:
            size = n[row]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            out.append(ids[np.arange(total) + np.repeat(at[row] - (ends - size), size)])
        return out


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray]]]:
    """Slices of batches of up to about size bytes of text, with the texts of their last column and their ids."""
    for batch in batches:
        start, texts, held = 0, [], 0
        for k, text in enumerate(column_values(batch.column(batch.num_columns - 1), 64)):
            texts.append(utf8(text))
            held += len(texts[-1])
            if held >= size or k + 1 == batch.num_rows:
                yield batch.slice(start, k + 1 - start), texts, encoder.encode(texts)
                start, texts, held = k + 1, [], 0


def load(spark, model: str = MODEL):
    """The encoder of a model file on the driver, as a broadcast variable: some MB, whatever the data."""
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast(Pieces(f.read()))


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, pieces): the ids of every text, without a shuffle.

    Null and empty texts have no pieces; repeated rows and rows without id are
    rows like others; other columns are ignored.
    """
    held = load(docs.sparkSession, model)

    def run(batches):
        for part, _, ids in _encoded(batches, Encoder(held.value)):
            n = np.array([len(x) for x in ids], np.int64)
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists], names=["doc_id", "n_pieces", "pieces"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, n_pieces bigint, pieces array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, pieces); null pieces give a null text, bytes that aren't UTF-8 a replacement character."""
    held = load(encoded.sparkSession, model)

    def run(batches):
        for batch in batches:
            texts = [None if x is None else held.value.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in column_values(batch.column(1), 64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, f"doc_id {id_type(encoded, 'doc_id')}, text string")


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, n_fallback, ids_sha256, decoded_sha256, round_trip) of every text; ids are digested as 32-bit little-endian numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = load(spark)
    names = ["doc_id", "n_pieces", "n_fallback", "ids_sha256", "decoded_sha256", "round_trip"]

    def run(batches):
        pieces = held.value
        fallback = np.zeros(pieces.size, bool)
        fallback[pieces.byte_ids] = True
        for part, texts, ids in _encoded(batches, Encoder(pieces)):
            decoded = [pieces.decode(x) for x in ids]
            columns = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([int(np.count_nonzero(fallback[x])) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                pa.array([x == y for x, y in zip(decoded, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.mapInArrow(run, f"doc_id {id_type(docs, 'doc_id')}, n_pieces bigint, n_fallback bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")
