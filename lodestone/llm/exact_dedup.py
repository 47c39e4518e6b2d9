"""Exact dedup by content sort, of DataFrame functions only.

Sampled splitters range-partition the normalised texts by their first characters and a 64-bit hash, so
that only short keys are sampled; the external sort of each range places equal texts side by side,
and each is compared in full with its neighbour: a text that differs begins a run, and one digest is
taken per run. A text with more than ``hot`` rows is counted beforehand and dealt into slices, each of
which has runs of its own; runs of one digest are folded to one group, of which the smallest
identifier is retained.

Nulls count as empty texts, which form one group; repeated rows of one doc_id count as copies, of which every
row is returned. A null doc_id is retained by none unless its whole group has none, and then no row is kept but
the group's keep_id is null. Empty tables give no rows; extra columns are not read. A text is compared whole
whatever its length, and must fit a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, small, stored, table, whole

#: Rows of one text that one task may hold, and the slices that more are dealt into.
HOT, SLICES = 2_000, 256
#: Characters of a text in the sampled keys.
LEAD = 16


def groups(docs: DataFrame, hot: int = HOT, slices: int = SLICES, key: Column | str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; ``key``, which may be a struct, is its identifier."""
    key = F.col(key) if isinstance(key, str) else key
    rows = docs.select(key.alias("doc_id"), F.regexp_replace(whole(), SPACE, " ").alias("norm")).withColumn("hash", F.xxhash64("norm"))
    # A text's rows are counted by its hash; other texts of that hash are merely dealt like it.
    many = stored(rows.groupBy("hash").agg(F.count("*").alias("copies")).where(F.col("copies") > hot).select("hash", F.lit(True).alias("many")), "hot-texts")
    dealt = rows.join(small(many), "hash", "left").select(
        "doc_id", "norm", "hash", F.substring("norm", 1, LEAD).alias("lead"),
        F.when(F.col("many"), F.pmod(F.xxhash64("doc_id"), F.lit(slices))).otherwise(F.lit(0)).cast("int").alias("slice"),
    )
    sorted_ = Window.partitionBy("lead", "hash", "slice").orderBy("norm", "doc_id")
    begins = F.coalesce(F.lag("norm").over(sorted_) != F.col("norm"), F.lit(True))
    ranged = dealt.repartitionByRange("lead", "hash", "slice").select("doc_id", "norm", "lead", "hash", "slice", begins.alias("begins"))
    # Only a run's first row needs the text's digest; the others take it over.
    digest = F.when(F.col("begins"), F.sha2(F.encode("norm", "UTF-8"), 256))
    runs = ranged.select("doc_id", F.last(digest, ignorenulls=True).over(sorted_.rowsBetween(Window.unboundedPreceding, 0)).alias("text_sha256"))
    runs = stored(runs, "runs")
    folded = runs.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return runs.join(folded, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
