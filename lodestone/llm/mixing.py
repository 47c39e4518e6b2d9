"""Mixing sources to target weights.

Every document gets a hash-random key; within its source the keys are sorted by ranges (their
leading hex digits, evenly filled because the key is a hash), running token counts come from a
prefix sum over the ranges plus one within each range, and each source is cut at its exact
budget. A budget above the source's size repeats it in whole epochs first. No task ever holds
a source: a hot one spreads over all ranges. Nulls as source form a source of their own, null
texts count zero words; with no words at all nothing is taken. Repeated rows are kept apart and each
takes its own share; of rows with one doc_id and size any may come first. Null doc_ids share one key.
Empty tables give no rows. Extra columns are not read unless ``carry`` names them. A very long text is one
document, which the cut may divide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table, whole

#: Hex digits of the key that name its range.
DIGITS = 3
MAX_EPOCHS = 3


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source (src, source, source_size): its rank's weight and its target in words.

    The excess over max_epochs times a source's size is shared anew by weight: every source
    gets the smaller of that limit and weight * level, where the levels' sum is all words. One
    row per source: the windows over all of them hold the list of sources, not documents."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn(
        "limit", F.col("source_size") * max_epochs
    )
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    leveled = (
        weighed.withColumn("before", F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("place", F.row_number().over(rising))
        .withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("left"))
    )
    # The level of the first source, in rising order, that its share does not fill.
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    level = F.min(F.when(fits, F.struct("place", "level"))).over(everything)["level"]
    return leveled.withColumn(
        "target", F.least(F.col("limit").cast("double"), F.col("weight") * F.coalesce(level, F.lit(0.0)))
    ).select("src", "source_size", "target")


def mix(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every document, and the
    columns of ``carry``."""
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"),
        F.regexp_count(whole(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        *carry,
    ).withColumn("range", F.substring("key", 1, DIGITS))
    sized = stored(sized, "mix-sizes")
    ranges = sized.groupBy("src", "source", "range").agg(F.sum("size").alias("words"))
    goals = targets(ranges.groupBy("src", "source").agg(F.sum("words").alias("source_size")))
    earlier = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(goals, "src")
        .select("src", "range", "start", "source_size", "target")
    )
    inside = Window.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(starts, ["src", "range"]).withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("at")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"), *carry)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS lim FROM s),
l AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM w),
v AS (SELECT *, CAST(total - before AS DOUBLE) / CAST(rest AS DOUBLE) AS level, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS place FROM l),
t AS (SELECT source, source_size, least(CAST(lim AS DOUBLE), weight * coalesce(arg_min(level, CASE WHEN level * weight <= lim THEN place END) OVER (), 0.0)) AS target FROM v),
p AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget,
  CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
  + greatest(0, least(size, budget % source_size - pos)) END AS BIGINT) AS taken FROM p
"""
