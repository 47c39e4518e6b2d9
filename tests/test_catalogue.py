"""Every registered table and track query against its SQL, and the golden values of the aggregates."""

import os
from decimal import Decimal

import duckdb
import pytest

from lodestone.operators import table as T
from lodestone.operators import tracks as K
from lodestone.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr(tuple(round(float(v), 5) + 0.0 if isinstance(v, (float, Decimal)) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.select(*(f"`{c}`" for c in columns)).collect()) == plain(want.fetchall())


def test_sample_deviation_and_null_counts(spark):
    df = spark.createDataFrame([("a", v) for v in (2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0)] + [("b", None), ("b", float("nan"))], "g string, v double")
    out = {r.g: r for r in T.summary_statistics(df, [("v", "std"), ("v", "sum")], ["g"]).collect()}
    assert out["a"].v_std == pytest.approx(2.138089935)
    assert out["b"]["count"] == 2 and out["b"].v_sum is None


def test_empty_input_without_groups_has_no_rows(spark):
    df = spark.createDataFrame([], "v double")
    assert T.summary_statistics(df, [("v", "sum")]).count() == 0


def test_first_and_last_pass_over_nulls_and_text_labels_keep_their_suffix(spark):
    df = spark.createDataFrame([(1, None, "v1.0"), (2, "b", "v1"), (3, "c", "v1"), (4, None, "v1.0")], "i long, t string, p string")
    row = T.summary_statistics(df, [("t", "first"), ("t", "last")], [], "i").first()
    assert (row.t_first, row.t_last) == ("b", "c")
    assert sorted(T.pivot_table(df, ["i"], "p", "i", "i").columns) == ["i", "v1", "v1_0"]


def test_incident_points_have_a_status(spark):
    df = spark.createDataFrame([("a", t, v, t) for t, v in enumerate([1, 9, 9, 9, 1, 9])] + [("a", None, 9, 9)], "k string, t long, v long, i long")
    got = K.detect_incidents(df, "k", "t", "v > 5", "i", "points").orderBy("t").collect()
    assert [(r.t, r.incident_id, r.incident_status) for r in got] == [(1, 1, "start"), (2, 1, "ongoing"), (3, 1, "end"), (5, 2, "start")]


def test_comparison_weights_of_a_consistent_matrix():
    weights, ratio = T.pairwise_comparison_weights([[1, 2, 4], [1 / 2, 1, 2], [1 / 4, 1 / 2, 1]])
    assert weights == pytest.approx([4 / 7, 2 / 7, 1 / 7]) and ratio == pytest.approx(0, abs=1e-9)


def test_boxcox_finds_the_log_of_lognormal_values(spark):
    df = spark.range(2000).selectExpr("exp((id - 1000) / 400.0) AS x")
    assert abs(T.boxcox_lambda(df, "x", 25)) < 0.05


def test_split_by_attributes_writes_a_folder_per_key(spark, tmp_path):
    T.split_by_attributes(spark.range(30).selectExpr("id", "id % 3 AS k"), ["k"], f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").glob("k=*")) == ["k=0", "k=1", "k=2"]
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 30


def test_transpose_numbers_rows_and_labels_fields(spark):
    df = spark.createDataFrame([(7, 1, 2), (5, 3, 4)], "i long, a long, b long")
    got = T.transpose_fields(df, ["a", "b"], ["i"], labels={"a": "first"}, row_id="i").collect()
    assert sorted((r.SRC_FID, r.FIELD, r.VALUE) for r in got) == [(0, "b", 4), (0, "first", 3), (1, "b", 2), (1, "first", 1)]
