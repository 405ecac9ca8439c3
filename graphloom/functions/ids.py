"""Component ids: p_1, po_1, pl_2, t_1 or i_1 above, with _s<i> for their sentences, rows and sub-images below."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODALITIES = {"p": "text", "t": "table", "i": "image"}


def underscores(cid: Column) -> Column:
    return F.length(cid) - F.length(F.replace(cid, F.lit("_"), F.lit("")))


def is_top(cid: Column) -> Column:
    """One underscore exactly."""
    return underscores(cid) == 1


def highest(cid: Column) -> Column:
    """The first two parts: the component of the upper layer, which is its own."""
    return F.concat_ws("_", F.slice(F.split(cid, "_"), 1, 2))


def parent(cid: Column) -> Column:
    """Without the last part.  Meant for lower components; unlike highest(), it spoils upper ones."""
    return F.regexp_replace(cid, "_[^_]*$", "")


def _named(letter: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in MODALITIES.items():
        out = F.when(letter == k, v).otherwise(out)
    return out


def modality(cid: Column) -> Column:
    """text, table or image by the first letter; null for others."""
    return _named(F.substring(cid, 1, 1))


def low_kind(cid: Column) -> Column:
    """The letter of the last part of a lower component; an error for upper ones."""
    last = F.substring(F.substring_index(cid, "_", -1), 1, 1)
    return F.when(underscores(cid) >= 2, last).otherwise(F.raise_error(F.concat(F.lit("not a lower component: "), cid)).cast("string"))


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
