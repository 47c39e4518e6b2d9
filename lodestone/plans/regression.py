"""Registered queries of the regression operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regression as R
from .registry import query, read, rounded

_R = "r AS (SELECT c_custkey, c_acctbal AS y, CAST(c_nationkey AS DOUBLE) AS a, CAST(c_custkey % 11 AS DOUBLE) AS b FROM customer)"
_B = "m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) * var_pop(b) - covar_pop(a, b) ** 2 AS d, covar_pop(a, y) * var_pop(b) - covar_pop(b, y) * covar_pop(a, b) AS p, covar_pop(b, y) * var_pop(a) - covar_pop(a, y) * covar_pop(a, b) AS q, var_pop(a) AS va, var_pop(b) AS vb FROM r)"
_F = f"{_R}, {_B}, f AS (SELECT c_custkey, y, my + p / d * (a - ma) + q / d * (b - mb) AS f FROM r, m)"


def _rows(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("y"), F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 11).alias("b"))


@query(f"WITH {_F} SELECT c_custkey, round(f, 5) AS glr_estimated, round(y - f, 5) AS glr_residual FROM f")
def generalized_linear_regression(spark, sf_dir):
    out = R.generalized_linear_regression(_rows(spark, sf_dir), "y", ["a", "b"])[0]
    return out.select("c_custkey", F.round("glr_estimated", 5).alias("glr_estimated"), F.round("glr_residual", 5).alias("glr_residual"))


@query(f"""WITH {_F}, s AS (SELECT sum((y - f) ** 2) / (count(*) - 3) AS s, count(*)::DOUBLE AS n FROM f) SELECT 'a' AS term, round(p / d, 6) AS coefficient, round(sqrt(s * vb / d / n), 6) AS std_error, round(va * vb / d, 6) AS vif FROM m, s
 UNION ALL SELECT 'b', round(q / d, 6), round(sqrt(s * va / d / n), 6), round(va * vb / d, 6) FROM m, s""")
def generalized_linear_regression_report(spark, sf_dir):
    report = R.generalized_linear_regression(_rows(spark, sf_dir), "y", ["a", "b"])[1].where("term <> 'Intercept'")
    return rounded(report.select("term", "coefficient", "std_error", "vif"), "coefficient", "std_error", "vif")


@query(f"""WITH {_R}, m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM r), l AS (SELECT *, (va + vb) / 2 + sqrt(((va - vb) / 2) ** 2 + c * c) AS l FROM m), e AS (SELECT *, (l - vb) / sqrt((l - vb) ** 2 + c * c) AS u, c / sqrt((l - vb) ** 2 + c * c) AS w FROM l)
 SELECT c_custkey, round(CASE WHEN (abs(u) > abs(w) AND u < 0) OR (abs(u) <= abs(w) AND w < 0) THEN -1 ELSE 1 END * (u * (a - ma) + w * (b - mb)), 5) + 0.0::DOUBLE AS "PC1" FROM r, e""")
def dimension_reduction(spark, sf_dir):
    out = R.dimension_reduction(_rows(spark, sf_dir), ["a", "b"], 1, standardize=False)[0]
    return out.select("c_custkey", (F.round("PC1", 5) + 0.0).alias("PC1"))


_K = "k AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 1009 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 1013 AS DOUBLE) AS y, s_suppkey * 37 % 1009 * 2.0::DOUBLE - s_suppkey * 91 % 1013 * 0.5::DOUBLE + s_suppkey % 7 AS u, s_suppkey * 37 % 1009 * 0.5::DOUBLE + s_suppkey * 91 % 1013 * 2.0::DOUBLE - s_suppkey % 5 AS v FROM supplier)"


@query(f"""WITH {_K}, c AS (SELECT s_suppkey, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y, u - avg(u) OVER () AS u, v - avg(v) OVER () AS v FROM k), t AS (SELECT sum(x * u + y * v) / sum(x * x + y * y) AS a, sum(x * v - y * u) / sum(x * x + y * y) AS b FROM c), r AS (SELECT s_suppkey, a * x - b * y - u AS rx, b * x + a * y - v AS ry FROM c, t)
 SELECT s_suppkey, round(rx, 5) + 0.0::DOUBLE AS "RESIDUAL_X", round(ry, 5) + 0.0::DOUBLE AS "RESIDUAL_Y", round(sqrt(rx * rx + ry * ry), 5) AS "RESIDUAL", round((rx * rx + ry * ry) / sum(rx * rx + ry * ry) OVER (), 6) AS "ERR_SHARE" FROM r""")
def calculate_transformation_errors(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = (k * 37) % 1009, (k * 91) % 1013
    links = read(spark, sf_dir, "supplier").select(k, x.cast("double").alias("x"), y.cast("double").alias("y"), (x * 2.0 - y * 0.5 + k % 7).alias("to_x"), (x * 0.5 + y * 2.0 - k % 5).alias("to_y"))
    out = R.calculate_transformation_errors(links, "similarity")[0].drop("x", "y", "to_x", "to_y")
    return out.withColumns({c: F.round(c, 5) + 0.0 for c in ("RESIDUAL_X", "RESIDUAL_Y", "RESIDUAL")}).withColumn("ERR_SHARE", F.round("ERR_SHARE", 6))
