"""Directions of lines without length."""

import duckdb

from lodestone.operators import zones as Z
from lodestone.plans import catalogue


def test_a_line_without_length_points_east_if_kept(spark):
    lines = spark.createDataFrame([(0.0, 0.0, 0.0, 2.0), (1.0, 1.0, 1.0, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    passed, kept = (Z.linear_directional_mean(lines, keep_points=k).first() for k in (False, True))
    assert (passed.n, passed.mean_len, round(passed.mean_dir, 6)) == (1, 2.0, 0.0)
    assert (kept.n, kept.mean_len, round(kept.mean_dir, 6)) == (2, 1.0, 45.0)


def test_directional_mean_of_a_customer_at_the_start_of_the_lines(spark, tmp_path):
    key = next(k for k in range(1009 * 1013) if k * 37 % 1009 == 450 and k * 91 % 1013 == 500)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT key::BIGINT AS c_custkey, 1 AS c_nationkey, 2.0::DOUBLE AS c_acctbal, 'A' AS c_mktsegment FROM (VALUES ({key}), ({key} + 5), ({key} + 7)) v(key)) TO '{tmp_path}/customer.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["central_feature_linear_directional_mean"]).fetchall()
    got = catalogue.QUERIES["central_feature_linear_directional_mean"](spark, str(tmp_path)).select("case", "mean_dir", "circ_var", "mean_len", "n", "kind").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r.n for r in got} == {3}
