"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 1-based positions in ``order``, which should be total for repeatable results.

    Range partitions are sorted in parallel and stored with their number: counts and positions
    must come from the one range sampling, and each evaluation of the plan would sample anew."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ranked",
    )
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in range(n):
        starts.append((part, total))
        total += counts.get(part, 0)
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    # n rows, one per shuffle partition.
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")


def global_running_sum(df: DataFrame, order: list[Column], of: str, name: str, rank: str | None = None) -> DataFrame:
    """df with the running sum of a column in ``order``, and if asked for the 1-based positions.

    Sums start from those of the range partitions before, and run within each by a window of its own."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = placed.groupBy("_part").agg(F.sum(of).alias("s"), F.count("*").alias("n")).collect()
    starts, total, before = [], 0.0, 0
    for row in sorted(sums, key=lambda r: r["_part"]):
        starts.append((row["_part"], float(total), before))
        total, before = total + (row["s"] or 0), before + row["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start double, _before long")
    inside = Window.partitionBy("_part").orderBy(*order)
    out = placed.join(F.broadcast(offsets), "_part")  # a row per shuffle partition
    out = out.withColumn(name, F.col("_start") + F.coalesce(F.sum(of).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    if rank:
        out = out.withColumn(rank, F.col("_before") + F.row_number().over(inside))
    return out.drop("_part", "_start", "_before")
