"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import uniform

#: The weights that the query and the pipeline mix to; "other" is the share of all sources without a name here.
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.1, "src4": 0.1}
OTHER, SEED = 0.4, 20240301
#: The largest mean of a Poisson table. A larger rate is the sum of as many equal shares as it takes, each drawn by itself, as
#: sums of Poisson numbers are Poisson numbers; so no table grows with the corpus.
SHARE = 32.0
#: The most copies of a document, on average, that can be asked for; beyond it mix() raises.
MOST = 10_000_000.0


def rates(docs: DataFrame, weights: dict[str, float], other: float, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(grp, rate): the mean number of copies of a document, for each named source and for all others (grp null).

    A source's rate is its share of the target, epochs times the size of docs,
    over its own size; sizes are in characters, at least one for each document.
    One row for each name in weights and one more, at most.
    """
    named = F.when(F.col(source_col).isin(list(weights)), F.col(source_col))
    share = F.lit(other)
    for name, weight in weights.items():
        share = F.when(F.col("grp") == name, F.lit(float(weight))).otherwise(share)
    total = sum(weights.values()) + other
    size = F.greatest(F.coalesce(F.length(text_col), F.lit(1)), F.lit(1)).cast("bigint")
    sizes = docs.select(named.alias("grp"), size.alias("size")).groupBy("grp").agg(F.sum("size").alias("size"))
    whole = F.sum("size").over(W.partitionBy())
    return sizes.select("grp", (share / F.lit(total) * F.lit(float(epochs)) * whole / F.col("size")).alias("rate"))


def thresholds(rates: DataFrame) -> DataFrame:
    """rates with shares, and cdf: the Poisson distribution function of rate / shares at 0, 1, ... as far as it differs from 1 in a double.

    A cdf has some 130 numbers at most.  A rate above MOST is an error.
    """
    too_many = F.concat(F.lit("more than "), F.lit(MOST), F.lit(" copies of each document of "), F.coalesce("grp", F.lit("other sources")))
    rates = rates.select("grp", F.when(F.col("rate") > MOST, F.raise_error(too_many).cast("double")).otherwise(F.col("rate")).alias("rate"))
    rates = rates.withColumn("shares", F.greatest(F.ceil(F.col("rate") / SHARE), F.lit(1).cast("bigint"))).withColumn("mean", F.col("rate") / F.col("shares"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30)
    each = rates.select("grp", "rate", "shares", "mean", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    upto = W.partitionBy("grp").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    log_p = F.when(F.col("mean") > 0, -F.col("mean") + F.col("k") * F.ln("mean") - F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0)).over(upto))
    each = each.withColumn("p", F.when(F.col("mean") > 0, F.exp(log_p)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0)))
    each = each.withColumn("c", F.sum("p").over(upto))
    return each.groupBy("grp", "rate", "shares").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    other: float,
    epochs: float = 1.0,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(doc, n_copies, copy, shuffle_key): every copy of every document, in a random order over all partitions.

    doc is a struct of all columns of docs, so that no name clashes.  A
    document's number of copies inverts the Poisson distribution function of
    its source's rate at a number hashed from seed, id and text: the same in any
    run and partitioning, and unchanged for most documents when weights move
    a little.  Copies are dealt and ordered by a hash of id, text and copy number, so
    a hot source spreads evenly.

    Null and unnamed sources share the weight other; a source of weight 0 goes
    away.  Null and empty texts count as one character.  Rows without id and
    rows that repeat one are drawn by their texts; those that repeat both, as
    they can't be told apart, get equal numbers of copies each.  A source so small that
    a document of it would need more than MOST copies is an error.  An empty table gives none.
    """
    table = thresholds(rates(docs.select(F.col(f"`{source_col}`"), F.col(f"`{text_col}`")), weights, other, epochs, source_col, text_col))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.when(F.col(f"`{source_col}`").isin(list(weights)), F.col(f"`{source_col}`")).alias("g"),
        F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("m"),
    )
    identity = F.col(f"doc.`{id_col}`")
    # The table has len(weights) + 1 rows at most.
    rows = rows.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("grp")))
    # A number for each share, hashed once, and then how many of the table's are not above it.
    drawn = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1), lambda j: uniform(seed, identity, F.col("m"), j))
    rows = rows.withColumn("us", drawn)
    count = F.aggregate("us", F.lit(0).cast("bigint"), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)).cast("bigint"))
    rows = rows.withColumn("n_copies", count).where("n_copies > 0")
    copies = rows.select("doc", "m", "n_copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))).alias("copy"))
    key = (uniform(seed + 1, identity, F.col("m"), F.col("copy")) * F.lit(float(2**48))).cast("bigint")
    copies = copies.withColumn("shuffle_key", key).drop("m")
    return copies.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """mix() of all documents: null sources are others, null texts count as one character, repeated rows are copied alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, WEIGHTS, OTHER).select("doc.doc_id", "doc.source", "doc.text", "n_copies", "copy", "shuffle_key")


_NAMES = ", ".join(f"'{x}'" for x in WEIGHTS)
_HASH = "('0x' || substr(md5({}), 1, 12))::bigint"
OP3_SQL = f"""
with d as (select *, case when source in ({_NAMES}) then source end as grp from documents),
s as (select grp, sum(greatest(coalesce(length(text), 1), 1)) as size from d group by grp),
r as (select grp, case {" ".join(f"when grp = '{k}' then {w}::double" for k, w in WEIGHTS.items())} else {OTHER}::double end
    / {sum(WEIGHTS.values()) + OTHER}::double * (sum(size) over ())::double / size as rate from s),
h as (select grp, greatest(ceil(rate / {SHARE}), 1)::bigint as shares, rate / greatest(ceil(rate / {SHARE}), 1)::bigint as mean from r),
k as (select grp, shares, mean, unnest(generate_series(0, ceil(mean + 12 * sqrt(mean) + 30)::bigint)) as k from h),
p as (select grp, shares, k, exp(-mean + k * ln(mean) - sum(case when k > 0 then ln(k) else 0 end) over (partition by grp order by k)) as p from k),
c as (select grp, shares, k, sum(p) over (partition by grp order by k) as c from p),
t as (select grp, shares, list(c order by k) as cdf from c group by grp, shares),
w as (select doc_id, source, text, md5(coalesce(text, '')) as m, cdf, shares from d join t on d.grp is not distinct from t.grp),
n as (select *, list_sum(list_transform(generate_series(0, shares - 1), lambda j: len(list_filter(cdf, lambda c: c <=
    {_HASH.format(f"'{SEED}:' || coalesce(doc_id::varchar, '') || ':' || m || ':' || j::varchar")} / {float(2**48)}))))::bigint as n_copies from w),
e as (select doc_id, source, text, m, n_copies, unnest(generate_series(1, n_copies)) as copy from n)
select doc_id, source, text, n_copies, copy, {_HASH.format(f"'{SEED + 1}:' || coalesce(doc_id::varchar, '') || ':' || m || ':' || copy::varchar")} as shuffle_key from e
"""
