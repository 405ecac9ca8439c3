"""Quality rules as a ledger: each rule is evaluated once, policies and ablations work on its bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_rows, utf8
from .words import _SPACE, Hasher, covered, repeated

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "longest_word", "n_ellipsis_lines", "n_bullet_lines"]

#: Bit k of a ledger's fail_bits is rule k: a name and an SQL condition on the measurements, true on failure.  Add rules at the end.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("few_alphabetic", "10 * n_alpha_words < 7 * n_words"),
    ("endless_word", "longest_word > 1000"),
    ("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
]
#: Versions of what is rejected; a version never changes once data were filtered by it.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(name for name, _ in RULES),
    "v2": tuple(name for name, _ in RULES if name not in ("ellipses", "bullets")),
}
_SYMBOLS = b"#*$%&|<>"
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def policy_mask(policy: str) -> int:
    return sum(1 << k for k, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def measure(text: str | None, hasher: Hasher) -> tuple[int, ...]:
    """MEASURES of one text; null counts as empty.

    A line counts with a word in it.  An alphabetic word has an ASCII letter
    or a character beyond ASCII; longest_word is in UTF-8 bytes.
    """
    data = utf8(text)
    starts, ends, hashes = hasher.words(data)
    n = len(starts)
    if not n:
        return (0,) * len(MEASURES)
    buf = np.frombuffer(data, np.uint8)
    chars = int(np.count_nonzero((buf & 0xC0) != 0x80)) - int(np.count_nonzero(_SPACE[buf]))
    again = repeated(hasher.windows(hashes, 5))
    repeats = int(np.count_nonzero(covered(again, 5, n))) if len(again) else 0
    alpha = int(np.count_nonzero(np.maximum.reduceat(_ALPHA[buf], starts)))
    lines = dups = dots = bullets = 0
    seen = set()
    for line in data.split(b"\n"):
        bare = line.strip()
        if bare:
            lines += 1
            dups += line in seen
            seen.add(line)
            dots += bare.endswith((b"...", "…".encode()))
            bullets += bare.startswith((b"-", b"*", "•".encode()))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    return n, chars, symbols, dups, repeats, lines, alpha, int((ends - starts).max()), dots, bullets


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, fail_bits): a row for each row of docs, in one pass over the texts without a shuffle.

    Null and empty texts measure zero and fail few_words; repeated rows,
    ties and rows without id are rows like others; other columns are ignored.
    """

    def rows():
        hasher = Hasher()
        return lambda text: measure(text, hasher)

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {id_type(docs, id_col)}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    made = map_rows(kept, schema, [(m, pa.int64()) for m in MEASURES], rows, ["doc_id"])
    bits = F.lit(0).cast("bigint")
    for k, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return made.withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with kept: whether none of the policy's rules fails."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy)).cast("bigint")) == 0)


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_only, n_rows, n_kept): what the policy rejects by each rule, and what only that rule rejects.

    Texts are not read again: rows are first counted by their bits, of which
    there are at most 2 ** rules combinations.
    """
    mask = policy_mask(policy)
    by = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("bigint").alias("bit")) for k, (name, _) in enumerate(RULES) if mask >> k & 1])
    each = by.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
    )


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the base rules and policy v1: null and empty texts fail as too short, repeated rows give repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = apply_policy(ledger(docs), "v1")
    base = F.col("fail_bits").bitwiseAND(F.lit(policy_mask("base")).cast("bigint")) != 0
    return judged.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "fail_bits", *MEASURES[5:])


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP2_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
g as (select doc_id, i, w[i:i+4] as gram from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1),
c as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, i + unnest([0, 1, 2, 3, 4]) as p from r) group by doc_id),
m as (select d.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as n_alpha_words,
    coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0)::bigint as longest_word,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as n_ellipsis_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(-|\*|•)'))) as n_bullet_lines
    from d left join c on c.doc_id = d.doc_id),
f as (select *, ({" + ".join(f"case when {sql} then {1 << k} else 0 end" for k, (_, sql) in enumerate(RULES))})::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (fail_bits & {policy_mask("base")}) <> 0 as base_failed, (fail_bits & {policy_mask("v1")}) = 0 as kept,
    fail_bits, n_lines, n_alpha_words, longest_word, n_ellipsis_lines, n_bullet_lines from f
"""


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    """ablation() of policy v1 over all documents: each rule's row, and what it rejects alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ablation(ledger(docs), "v1")


_MASK = policy_mask("v1")
_RULES = ", ".join(f"('{name}', {1 << k}::bigint)" for k, (name, _) in enumerate(RULES) if _MASK >> k & 1)
ABLATION_SQL = f"""
with l as (select fail_bits & {_MASK} as bits from ({OP2_SQL}))
select rule, count(*) filter (bits & bit <> 0) as n_failed, count(*) filter (bits = bit) as n_only, count(*) as n_rows, count(*) filter (bits = 0) as n_kept
from l, (values {_RULES}) r(rule, bit) group by rule
"""
