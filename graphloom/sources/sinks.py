"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_lines(df: DataFrame, path: str) -> None:
    """A JSON line for each row, added to what is there."""
    df.write.mode("append").json(path)


def overwrite_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark, path: str) -> bool:
    p, files = _folder(spark, path)
    return files.exists(p) and files.getFileStatus(p).isDirectory()


def guarded(df: DataFrame, path: str, force_overwrite: bool = False) -> None:
    """Parquet in a folder that is not there yet; FileExistsError if it is, unless it may be overwritten."""
    if not force_overwrite and exists(df.sparkSession, path):
        raise FileExistsError(f"{path} is there already")
    df.write.mode("overwrite").parquet(path)


def save_graph(tables: dict[str, DataFrame], path: str) -> None:
    """A graph's tables, a folder each, to be read by load_graph()."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def save_config(spark, config: dict, path: str) -> None:
    """A run's settings as one JSON line."""
    import json

    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def formatted(df: DataFrame) -> DataFrame:
    """Fractions as text of four decimals, for reports."""
    return df.select(*[F.format_string("%.4f", F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


def _folder(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replaced(df: DataFrame, path: str) -> DataFrame:
    """The table at path with df in its place, which may be made from it: written beside it first, then swapped by renaming.

    A run that fails before the swap leaves the old table as it was.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}_new")
    old, files = _folder(spark, path)
    new, _ = _folder(spark, f"{path}_new")
    aside, _ = _folder(spark, f"{path}_old")
    files.delete(aside, True)
    if files.exists(old):
        files.rename(old, aside)
    files.rename(new, old)
    files.delete(aside, True)
    return spark.read.schema(df.schema).parquet(path)


def artifact(spark, source: str, path: str) -> DataFrame:
    """The working copy at path of the table at source, which stays as it is; made on first use."""
    if not exists(spark, path):
        guarded(spark.read.parquet(source), path)
    return spark.read.parquet(path)


def write_file(spark, path: str, data: bytes) -> None:
    """A small file, such as settings or a picture, in whatever store the path is of."""
    p, files = _folder(spark, path)
    out = files.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_settings(spark, path: str, root: str = "") -> dict:
    """A YAML or JSON file of settings in whatever store the path is of, with ${REPO_ROOT} replaced."""
    from .readers import parse_yaml

    return parse_yaml(spark.read.text(path, wholetext=True).first()[0], root)
