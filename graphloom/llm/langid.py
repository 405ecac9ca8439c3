"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_values, uniform, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
REACH = max(WIDTHS) - 1
#: Bounds of the training sample: documents of a language, windows of a document, and languages (the most frequent).
DOCS_PER_LANG, WINDOWS_PER_DOC, MAX_LANGS = 400, 6, 512


class Network:
    """Bytes -> embedding -> filters of several widths -> ReLU -> maximum over the window -> softmax."""

    def __init__(self, classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"emb": rng.normal(0, 0.5, (256, DIM)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.p["bias"] = np.zeros(classes, np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of windows x (n, WINDOW + REACH) with classes y, and its gradients."""
        p, n = self.p, len(x)
        e = p["emb"][x]
        pooled, where, columns = [], [], []
        for w in WIDTHS:
            c = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)[:, :WINDOW].transpose(0, 1, 3, 2).reshape(n, WINDOW, w * DIM)
            z = c @ p[f"w{w}"]
            at = z.argmax(axis=1)
            where.append(at)
            columns.append(c[np.arange(n)[:, None], at])
            pooled.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + p[f"b{w}"])
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        logit = h @ p["out"] + p["bias"]
        logit -= logit.max(axis=1, keepdims=True)
        prob = np.exp(logit)
        prob /= prob.sum(axis=1, keepdims=True)
        loss = float(-np.log(prob[np.arange(n), y] + 1e-9).mean())
        d = prob
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "bias": d.sum(axis=0), "emb": np.zeros_like(p["emb"])}
        dh = (d @ p["out"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            dz = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = dz.sum(axis=0)
            g[f"w{w}"] = np.einsum("nfc,nf->cf", columns[k], dz)
            dc = (dz[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, DIM)
            places = x[np.arange(n)[:, None, None], where[k][:, :, None] + np.arange(w)]
            np.add.at(g["emb"], places, dc)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 900, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
        """Adam for a fixed number of steps with a falling rate."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(batch, len(x)))
            _, g = self.gradients(x[pick], y[pick])
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                step = rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
                self.p[k] = (self.p[k] - step).astype(np.float32)
        return self

    def tables(self) -> Tables:
        return Tables(self.p)


class Tables:
    """The trained network for inference: what two bytes in a row add to each filter is looked up, not multiplied."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        each = {w: np.einsum("bd,kdf->kbf", p["emb"], p[f"w{w}"].reshape(w, DIM, FILTERS)) for w in WIDTHS}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        zero = np.zeros((256, FILTERS), np.float32)
        self.first = np.concatenate([pair(each[w][0], each[w][1]) for w in WIDTHS], axis=1).astype(np.float32)
        self.second = np.concatenate([pair(each[w][2], each[w][3] if w > 3 else zero) for w in WIDTHS[1:]], axis=1).astype(np.float32)
        self.bias = np.concatenate([p[f"b{w}"] for w in WIDTHS])
        self.out, self.out_bias = p["out"], p["bias"]

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        """Log probabilities of windows (n, WINDOW + REACH) of bytes."""
        h = np.empty((len(windows), FILTERS * len(WIDTHS)), np.float32)
        for k in range(0, len(windows), 32):
            x = windows[k : k + 32].astype(np.intp)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            z = self.first[pairs[:, :WINDOW]]
            z[:, :, FILTERS:] += self.second[pairs[:, 2 : WINDOW + 2]]
            z.max(axis=1, out=h[k : k + 32])
        logit = np.maximum(h + self.bias, 0) @ self.out + self.out_bias
        logit -= logit.max(axis=1, keepdims=True)
        return logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))


def windows_of(data: bytes) -> np.ndarray:
    """All of a text as rows of WINDOW bytes and the REACH bytes that follow each; zero bytes stand after its end."""
    n = max(1, -(-len(data) // WINDOW))
    buf = np.zeros(n * WINDOW + REACH, np.uint8)
    buf[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, WINDOW + REACH)[::WINDOW]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(tables: Tables | None, languages: list[str], texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text, from the windows' mean log probabilities weighted by their bytes."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not languages:
        return out
    todo = [k for k, t in enumerate(texts) if has_letter(t)]
    if not todo:
        return out
    datas = [utf8(texts[k]) for k in todo]
    parts = [windows_of(d) for d in datas]
    size = np.array([len(p) for p in parts])
    logp = tables.log_probs(np.concatenate(parts))
    weight = np.full(len(logp), float(WINDOW))
    ends = np.cumsum(size)
    weight[ends - 1] = [len(d) - WINDOW * (len(p) - 1) for d, p in zip(datas, parts, strict=True)]
    sums = np.add.reduceat(logp * weight[:, None], ends - size, axis=0) / np.add.reduceat(weight, ends - size)[:, None]
    prob = np.exp(sums - sums.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    for k, best, p in zip(todo, prob.argmax(axis=1).tolist(), prob.max(axis=1).tolist(), strict=True):
        out[k] = (languages[best], float(p))
    return out


def held_out(id_col) -> F.Column:
    """Documents never learned from: the CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 11, steps: int = 900) -> tuple[Tables | None, list[str]]:
    """A network and its languages from a bounded sample of the labelled documents that aren't held out.

    Each language gives up to DOCS_PER_LANG documents, drawn by a hash of the
    id, and each of these up to WINDOWS_PER_DOC windows spread over the whole
    text.  Only these windows come to the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return None, []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 1.5 * DOCS_PER_LANG / r["count"]))])
    drawn = rows.withColumn("u", uniform(seed, F.col("id"))).where(F.col("u") < share[F.col("lang")]).select("u", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for u, lang, text in zip(*(column_values(batch.column(k), 64) for k in range(3)), strict=True):
                if has_letter(text):
                    w = windows_of(utf8(text))
                    pick = np.unique(np.linspace(0, len(w) - 1, WINDOWS_PER_DOC).astype(int))
                    out.append((u, lang, w[pick].tobytes()))
            u, lang, w = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.float64()), pa.array(lang, pa.string()), pa.array(w, pa.binary())], names=["u", "lang", "w"])

    sample = sorted(drawn.mapInArrow(run, "u double, lang string, w binary").collect(), key=lambda r: (r.lang, r.u, bytes(r.w)))
    languages, x, y, taken = [], [], [], {}
    for r in sample:
        if taken.get(r.lang, 0) >= DOCS_PER_LANG:
            continue
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if not languages or languages[-1] != r.lang:
            languages.append(r.lang)
        own = np.frombuffer(bytes(r.w), np.uint8).reshape(-1, WINDOW + REACH)
        x.append(own)
        y += [len(languages) - 1] * len(own)
    if not languages:
        return None, []
    x, y = np.concatenate(x), np.array(y)
    even = np.concatenate([np.resize(np.flatnonzero(y == k), np.bincount(y).max()) for k in range(len(languages))])
    x, y = x[even], y[even]
    # Half of the sample again, cut short, so that short texts are known too.
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))[: (len(x) + 1) // 2]
    short = x[order].copy()
    short[np.arange(WINDOW + REACH)[None, :] >= rng.integers(12, WINDOW, len(short))[:, None]] = 0
    network = Network(len(languages)).fit(np.concatenate((x, short)), np.concatenate((y, y[order])), steps)
    return network.tables(), languages


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model=None, keep: list[str] | None = None) -> DataFrame:
    """docs' columns, or those of keep, in a struct doc, with lang_pred and score, for each row.

    Learns from docs unless a model from fit() is given.  Null texts and texts
    without a letter are "und" with score 0, as are all if there is no labelled
    document.  Repeated rows give repeated rows; a row without id isn't learned
    from.  Column names can't clash.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model or fit(docs, id_col, text_col, lang_col))
    whole = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns])
    rows = docs.select(whole.alias("doc"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        tables, languages = held.value
        for batch in batches:
            made = []
            texts: list[str | None] = []
            size = 0
            for text in column_values(batch.column(1), 64):
                texts.append(text)
                size += len(text or "")
                if size > 1 << 20:
                    made += predict(tables, languages, texts)
                    texts, size = [], 0
            made += predict(tables, languages, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["doc", "lang_pred", "score"]
            )

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"]]).add("lang_pred", "string").add("score", "double"))


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """identify() of all documents: null texts and those without a letter are "und", repeated rows give repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    made = identify(docs, keep=["doc_id"])
    return made.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")
