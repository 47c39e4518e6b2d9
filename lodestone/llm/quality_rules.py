"""Quality rules as a bitmask ledger: each rule is measured once per document, its failure
stored as a bit beside the measurements; versioned policies are masks over those bits, and
ablations are bitwise aggregations over the stored ledger, never a second look at the texts.

Null or blank texts have no words and fail ``few_words``. Repeated rows and null doc_ids are judged like any
others, row by row. Empty tables give an empty ledger. Extra columns of the input are not read unless they
are to be carried. A text is measured whole whatever its length, in arrays of its words. Built of
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, whole, words

#: Rule name -> SQL condition of failure over the measurements; the position is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repetition": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE = ("few_words", "repetition")
#: Version -> rules it enforces. Published versions are never edited, only added to.
POLICIES = {"v1": BASE, "v2": tuple(RULES)}


def mask(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _once(df: DataFrame, **columns) -> DataFrame:
    """df with columns that are evaluated once per row however often they are used later: the optimiser
    inlines projections into each other, but not through a generator."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_made")
    return df.select("*", made).select(*(f"`{c}`" for c in df.columns), *(f"_made.{n}" for n in columns))


def measure(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id and the measurements of every whole text; with ``keep`` also ``row``, the whole input row."""
    carried = ["doc_id", "row"] if keep else ["doc_id"]
    source = docs.select("doc_id", whole().alias("text"), *([F.struct("*").alias("row")] if keep else []))
    base = _once(source, w=words(F.col("text")), lines=F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # 3-word windows sorted with their positions: equal ones become neighbours.
    windows = F.expr(
        """sort_array(transform(
             filter(sequence(0, size(w)), i -> i < size(w) - 2),
             i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g, i AS p)))"""
    )
    sorted_ = _once(base, s=windows)
    # A window is repeated when it equals the one before or after it in that order.
    repeats = F.expr(
        """sort_array(transform(
             filter(s, (x, k) -> x.g <=> get(s, k + 1).g OR x.g <=> get(s, k - 1).g),
             x -> x.p))"""
    )
    repeated = _once(sorted_, r=repeats)
    symbols = F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))
    # Each start covers three words, less what the next start covers as well.
    covered = F.expr("aggregate(transform(r, (x, k) -> CAST(least(3, coalesce(get(r, k + 1) - x, 3)) AS bigint)), 0L, (a, x) -> a + x)")
    return _once(
        repeated,
        n_words=F.size("w").cast("long"),
        word_chars=F.length(F.array_join("w", "")).cast("long"),
        n_symbols=symbols.cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=covered,
    ).select(*carried, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, keep: bool = False) -> DataFrame:
    """The measurements and ``fail_bits``: bit k is set where rule k fails."""
    bits = [F.when(F.expr(c), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return measure(docs, keep).withColumn("fail_bits", out)


def ledger(docs: DataFrame, keep: bool = False) -> DataFrame:
    """The stored ledger."""
    return stored(judged(docs, keep), "ledger")


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablation(rows: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of a policy: documents failing it, and those only it rejects."""
    m = mask(POLICIES[version])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("b")).count()
    cases = [F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[version]]
    each = patterns.select("b", "count", F.explode(F.array(*cases)).alias("c"))
    return each.groupBy(F.col("c.rule").alias("rule")).agg(
        F.sum(F.when(F.col("b").bitwiseAND(F.col("c.bit")) != 0, F.col("count")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("b") == F.col("c.bit"), F.col("count")).otherwise(0)).alias("failed_only"),
    )


def sole_rule(version: str = "v2"):
    """The one rule of a policy that rejects a document, whose removal would keep it; else null."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long"))
    return F.coalesce(*(F.when(failed == 1 << list(RULES).index(r), F.lit(r)) for r in POLICIES[version]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    # One row per rule of the policy.
    alone = F.broadcast(ablation(rows).select(F.col("rule").alias("sole_rule"), F.col("failed_only").alias("sole_rule_docs")))
    judged = apply_policy(apply_policy(rows, "v1").withColumnRenamed("kept", "kept_v1"))
    return judged.withColumn("sole_rule", sole_rule()).join(alone, "sole_rule", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0).alias("base_failed"), "kept", "fail_bits", "kept_v1", "sole_rule", "sole_rule_docs",
    )


_CASES = " ".join(f"WHEN {1 << k} THEN '{r}'" for k, r in enumerate(RULES))
_FAIL = " + ".join(f"(CASE WHEN {c} THEN {1 << k} ELSE 0 END)" for k, c in enumerate(RULES.values()))
SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) > 2),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM h WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST({_FAIL} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask(BASE)} <> 0 AS base_failed,
  fail_bits = 0 AS kept, fail_bits, fail_bits & {mask(BASE)} = 0 AS kept_v1, CASE fail_bits {_CASES} END AS sole_rule,
  CASE WHEN fail_bits IN ({', '.join(str(1 << k) for k in range(len(RULES)))}) THEN count(*) OVER (PARTITION BY fail_bits) END AS sole_rule_docs FROM f
"""
