"""Global row numbers on tables beyond the range sampler's sample."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.ranking import global_row_number
from lodestone.operators import table as T


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_row_numbers_of_a_large_table(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.range(60_000).select("id", (F.xxhash64("id") % 1000).alias("v"))
        out = global_row_number(df, [F.col("v"), F.col("id")], "k")
        # Each position once, and the order of any two neighbours right.
        s = out.agg(F.count("*").alias("n"), F.count_distinct("k").alias("d"), F.min("k").alias("a"), F.max("k").alias("b")).first()
        assert (s.n, s.d, s.a, s.b) == (60_000, 60_000, 1, 60_000)
        a, b = out.alias("a"), out.alias("b")
        wrong = a.join(b, F.expr("b.k = a.k + 1")).where("a.v > b.v OR (a.v = b.v AND a.id > b.id)")
        assert wrong.count() == 0
        same = spark.range(60_000).select("id", F.pmod(F.xxhash64("id"), F.lit(20_021)).alias("g"))
        groups = T.find_identical(same, ["g"], "id").groupBy("g").agg(F.min("dup_group").alias("a"), F.max("dup_group").alias("b"))
        found = groups.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d"), F.max("b").alias("top"), F.count_if(F.col("a") != F.col("b")).alias("split")).first()
        assert found.n == found.d == found.top + 1 and found.split == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
