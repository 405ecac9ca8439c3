"""Places for encoders and language models, with deterministic ones for tests."""

from __future__ import annotations

import hashlib
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kept import Kept

_WORDS = re.compile(r"[a-z0-9]+").findall


class Registry:
    """Names for factories; a name is given once."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def register(self, name: str) -> Callable:
        def keep(value):
            if name in self.known:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.known[name] = value
            return value

        return keep

    def get(self, name: str):
        if name not in self.known:
            raise ValueError(f"{self.kind} {name!r} is not registered; known are {', '.join(sorted(self.known))}")
        return self.known[name]

    def names(self) -> list[str]:
        return sorted(self.known)


ENCODERS, LANGUAGE_MODELS, QA_SCHEMAS = Registry("encoder"), Registry("language model"), Registry("QA schema")


class Encoder(ABC):
    """Vectors for texts.  A worker makes one, loads it, gives it batches and lets it go."""

    def load_model(self) -> None:
        """Get ready; called once a worker."""

    def delete_model(self) -> None:
        """Free what load_model() took."""

    @abstractmethod
    def encode_corpus(self, texts: list[str], images: list[list[str]]) -> np.ndarray:
        """A row for each component."""

    def encode_queries(self, texts: list[str]) -> np.ndarray:
        """A row for each question; by default as components without images."""
        return self.encode_corpus(texts, [[] for _ in texts])


@ENCODERS.register("hashing")
class HashingEncoder(Encoder):
    """Words hashed to signed dimensions, at length 1; image paths count as words.  A text without words is a zero vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.codes = Kept(self._code)

    def _code(self, word: str) -> int:
        """Where a word counts: dimensions it is taken from, then those it is added to."""
        h = int(hashlib.md5(word.encode()).hexdigest()[:12], 16)
        return h % 2 * self.dim + h // 2 % self.dim

    def encode_corpus(self, texts, images):
        out = np.zeros((len(texts), self.dim))
        for at in range(0, len(texts), 512):
            codes, sizes = [], []
            for text, paths in zip(texts[at : at + 512], images[at : at + 512], strict=True):
                found = [*_WORDS((text or "").lower()), *paths]
                codes += map(self.codes.__getitem__, found)
                sizes.append(len(found))
            places = np.repeat(np.arange(len(sizes)) * 2 * self.dim, sizes) + np.array(codes, np.int64)
            counts = np.bincount(places, minlength=len(sizes) * 2 * self.dim).reshape(len(sizes), 2, self.dim)
            out[at : at + 512] = counts[:, 1] - counts[:, 0]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def encode(df: DataFrame, encoder: Callable[[], Encoder], text_col: str = "text", images_col: str | None = None, queries: bool = False, out: str = "vec") -> DataFrame:
    """df with a vector of each row's text and images; encoder makes an Encoder on each worker."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = encoder()
        model.load_model()
        try:
            for texts, images in batches:
                said = [t or "" for t in texts.to_pylist()]
                made = model.encode_queries(said) if queries else model.encode_corpus(said, [x or [] for x in images.to_pylist()])
                made = np.asarray(made, np.float64).reshape(len(said), -1 if said else 0)
                ends = np.arange(len(said) + 1, dtype=np.int32) * made.shape[1]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel()))
        finally:
            model.delete_model()

    images = F.col(images_col) if images_col else F.array().cast("array<string>")
    return df.withColumn(out, run(F.col(text_col), images))


def generate(prompt: Column, model: Callable[[], Callable[[str], str]]) -> Column:
    """What a language model answers to each prompt; model makes a function from prompt to answer on each worker.  A prompt that fails answers the empty string."""
    return generated(prompt, model)["answer"]


_ANSWER = T.StructType().add("answer", "string").add("error", "string")


def generated(prompt: Column, model: Callable[[], Callable[[str], str]]) -> Column:
    """(answer, error): generate() with what went wrong, null if nothing did.

    A model that can't be made at all is an error of the job.
    """

    @F.pandas_udf(_ANSWER)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = model()

        def one(p) -> tuple[str, str | None]:
            try:
                return ask(p), None
            except Exception as e:  # as one prompt too long must not end the job
                return "", f"{type(e).__name__}: {e}"

        for batch in batches:
            yield pd.DataFrame([one(p) for p in batch], columns=["answer", "error"], dtype=object)

    return run(prompt)


#: What vectors need of each kind of component: (encoder, type of set, component) -> (max_length, batch_size).  A set's own entry, with its name for the type, goes before.
EncoderParameters = dict[tuple[str, str, str], tuple[int, int]]


def encoding_plan(spark, runs: list[tuple[str, str]], components: list[str], parameters: EncoderParameters, encoder: str, only_sets: list[str] | None = None, only_components: list[str] | None = None) -> DataFrame:
    """(dataset, component, max_length, batch_size) for each set (name, type) and component that parameters, its own or its type's, are known for."""
    p = [(e, t, c, *v) for (e, t, c), v in parameters.items()]
    table = spark.createDataFrame(p, "encoder string, type string, component string, max_length int, batch_size int").where(F.col("encoder") == encoder).drop("encoder")
    sets = spark.createDataFrame(runs, "dataset string, kind string").select("dataset", "kind", F.explode(F.array(*[F.lit(c) for c in components])).alias("component"))
    if only_sets:
        sets = sets.where(F.col("dataset").isin(only_sets))
    if only_components:
        sets = sets.where(F.col("component").isin(only_components))
    own = table.select(F.col("type").alias("dataset"), "component", F.struct("max_length", "batch_size").alias("own"))
    default = table.select(F.col("type").alias("kind"), "component", F.struct("max_length", "batch_size").alias("default"))
    both = sets.join(own, ["dataset", "component"], "left").join(default, ["kind", "component"], "left")
    return both.select("dataset", "component", F.coalesce("own", "default").alias("v")).where("v is not null").select("dataset", "component", "v.max_length", "v.batch_size")
