"""Whether a set is ready: a table of its problems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DOCUMENT_KEYS, SET_KEYS
from ..functions.models import QA_SCHEMAS


def registration_problems(name: str, sets: dict, sets_by_type: dict, encoders: dict) -> list[str]:
    """What is wrong with a set's settings.

    encoders has the parameters of each encoder: by_type, by set type, and
    by_set, by set name; one of them must be there.
    """
    if name not in sets:
        return [f"{name}: not registered"]
    own = sets[name]
    out = [f"{name}: {key} is missing" for key in SET_KEYS if key not in own]
    kind = own.get("type")
    if kind and name not in sets_by_type.get(kind, []):
        out.append(f"{name}: not listed under type {kind}")
    for encoder, known in encoders.items():
        if not known.get("by_type", {}).get(kind) and not known.get("by_set", {}).get(name):
            out.append(f"{name}: encoder {encoder} has no parameters for it or its type")
    schema = own.get("qa_schema")
    if not schema:
        out.append(f"{name}: qa_schema is missing or empty")
    elif schema not in QA_SCHEMAS.known:
        out.append(f"{name}: qa_schema {schema} is not registered; known are {', '.join(QA_SCHEMAS.names())}")
    return out


def document_problems(documents: DataFrame, file_col: str = "file", keys: tuple[str, ...] = DOCUMENT_KEYS) -> DataFrame:
    """(file, problem) of parsed documents that lack a key; a key that no document has is a problem of all of them."""
    lacking = [F.when(F.col(k).isNull() if k in documents.columns else F.lit(True), F.lit(k)) for k in keys]
    missing = F.filter(F.array(*lacking), lambda k: k.isNotNull())
    return documents.select(F.col(file_col).alias("file"), F.concat(F.lit("missing "), F.array_join(missing, ", ")).alias("problem"), F.size(missing).alias("n")).where("n > 0").drop("n")


def rule_problems(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(key, problem): each rule, a name and an SQL condition that should hold, that a row fails, in one pass; unknown counts as failing."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(failed).alias("problem"))


def validate(spark, name: str, sets: dict, sets_by_type: dict, encoders: dict, documents: DataFrame | None = None) -> DataFrame:
    """(problem): all of a set's problems; none if it is ready."""
    found = spark.createDataFrame([(p,) for p in registration_problems(name, sets, sets_by_type, encoders)], "problem string")
    if documents is None:
        return found
    own = document_problems(documents)
    return found.unionByName(own.select(F.concat("file", F.lit(": "), "problem").alias("problem")))
