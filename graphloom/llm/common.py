"""What the operators share: cutting lineage, hashing and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir; only where none is set and all runs in one process, as in tests, a folder of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphloom-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: later stages survive lost executors."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to the shared checkpoint folder, under a name of their own, and read again.

    They are compressed, unlike checkpoints, and survive lost executors.  The
    shuffle files that a table was made from go as soon as it is written.
    drop() removes tables that no later plan reads; those that a lazy result
    reads stay with the session's other checkpoints.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        set_checkpoint_dir(spark)
        self.spark = spark
        self.path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
        self.written: set[str] = set()

    def write(self, name: str, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(self._CLEANUP, None)
        self.spark.conf.set(self._CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
            self.written.add(name)
        finally:
            if before is None:
                self.spark.conf.unset(self._CLEANUP)
            else:
                self.spark.conf.set(self._CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.written.discard(name)

    def keep_only(self, *names: str) -> None:
        self.drop(*(self.written - set(names)))


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def column_values(column: pa.ChunkedArray | pa.Array, step: int = 512) -> Iterator:
    """Python values of a column, a few hundred at a time, so that a batch isn't held twice."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def map_rows(
    df: DataFrame, schema, outputs: list[tuple[str, pa.DataType]], rows: Callable[[], Callable], keep: list[str]
) -> DataFrame:
    """Append computed columns to the columns in keep.

    rows() is called once a task and returns a function from the values of the
    last column of df (the text) to a tuple of outputs.  df has the columns of
    keep and then the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = rows()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = [one(x) for x in column_values(part.column(part.num_columns - 1), 128)]
                columns = list(zip(*made, strict=True)) if made else [[] for _ in outputs]
                arrays = [pa.array(c, type=t) for c, (_, t) in zip(columns, outputs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(part.num_columns - 1)] + arrays, names=keep + [n for n, _ in outputs]
                )

    return df.mapInArrow(run, schema)


def unused(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores behind it as make it no column's."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def whole_id(df: DataFrame, name: str) -> None:
    """TypeError if the column isn't one of whole numbers, which the least or the next of are asked for."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{name} has to be a column of whole numbers, not of {kind.simpleString()}")


def uniform(seed: int, *columns) -> F.Column:
    """A number in [0, 1) from 48 bits of an MD5 sum: the same in every run, engine and partitioning."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
