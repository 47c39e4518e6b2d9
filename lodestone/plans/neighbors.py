"""Registered queries of the neighbour operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors as N
from ..operators import proximity as P
from .proximity import _A, _B, _DIST, _points, _sql
from .registry import query, rounded

_S = _sql("s", "supplier", "s_suppkey", ", CAST(s_suppkey * 13 % 50 + 1 AS DOUBLE) AS v")
_SP = f"p AS (SELECT a.fid AS i, b.fid AS j, {_DIST} AS d, b.v FROM s a, s b WHERE a.fid <> b.fid), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM p)"
_C = _sql("s", "customer", "c_custkey", ", c_acctbal AS v, c_mktsegment AS g")
_ALPHA = "0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))"


def _suppliers(spark, sf_dir):
    return _points(spark, sf_dir, "supplier", "s_suppkey", ((F.col("s_suppkey") * 13) % 50 + 1).cast("double").alias("v"))


def _customers(spark, sf_dir):
    return _points(spark, sf_dir, "customer", "c_custkey", F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("g"))


@query(f"""WITH {_C}, {_SP} SELECT i AS feature_id, round(d, 6) AS kth_neighbor_distance, 'euclidean' AS metric FROM r WHERE r = 3 UNION ALL
 SELECT i, d, 'manhattan' FROM (SELECT a.fid AS i, abs(a.x - b.x) + abs(a.y - b.y) AS d, row_number() OVER (PARTITION BY a.fid ORDER BY abs(a.x - b.x) + abs(a.y - b.y), b.fid) AS r FROM s a, s b WHERE a.fid <> b.fid) WHERE r = 2""")
def calculate_distance_band(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    both = N.calculate_distance_band(rows, 3).withColumn("metric", F.lit("euclidean")).union(N.calculate_distance_band(rows, 2, "manhattan").withColumn("metric", F.lit("manhattan")))
    return rounded(both, "kth_neighbor_distance")


_METHODS = {"knn": {"neighbors": 4}, "fixed_distance_band": {"method": "fixed_distance_band", "threshold": 300.0}, "inverse_distance": {"method": "inverse_distance", "threshold": 300.0}}
_W = f"""{_S}, {_SP}, w0 AS (SELECT 'knn' AS m, i, j, 1.0::DOUBLE AS w FROM r WHERE r <= 4 UNION ALL SELECT 'fixed_distance_band', i, j, 1.0 FROM p WHERE d <= 300 UNION ALL SELECT 'inverse_distance', i, j, 1 / d FROM p WHERE d <= 300),
 w AS (SELECT m, i, j, w / sum(w) OVER (PARTITION BY m, i) AS w FROM w0)"""


@query(f"WITH {_W} SELECT CAST(i AS VARCHAR) AS origin_id, CAST(j AS VARCHAR) AS neighbor_id, round(w, 6) AS weight, m AS method FROM w")
def generate_spatial_weights_matrix(spark, sf_dir):
    rows = _suppliers(spark, sf_dir)
    made = [N.generate_spatial_weights_matrix(rows, **options).withColumn("method", F.lit(name)) for name, options in _METHODS.items()]
    return rounded(made[0].union(made[1]).union(made[2]), "weight")


@query(f"""WITH {_W}, z AS (SELECT fid, v - avg(v) OVER () AS z FROM s), q AS (SELECT count(*)::DOUBLE AS n, sum(z * z) AS m2 FROM z), u AS (SELECT m, i, j, w FROM w UNION ALL SELECT m, j, i, w FROM w),
 s0 AS (SELECT m, sum(w) AS s0, count(*) AS links FROM w GROUP BY m), s1 AS (SELECT m, sum(w * w) / 2 AS s1 FROM (SELECT m, i, j, sum(w) AS w FROM u GROUP BY ALL) GROUP BY m), s2 AS (SELECT m, sum(w * w) AS s2 FROM (SELECT m, i, sum(w) AS w FROM u GROUP BY ALL) GROUP BY m),
 x AS (SELECT m, sum(w * a.z * b.z) AS c FROM w JOIN z a ON a.fid = i JOIN z b ON b.fid = j GROUP BY m), f AS (SELECT m, n, links, n / s0 * c / m2 AS i, -1 / (n - 1) AS e, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / (n - 1) ** 2 AS var FROM s0 JOIN s1 USING (m) JOIN s2 USING (m) JOIN x USING (m), q)
 SELECT m AS method, 'v' AS field, round(i, 6) AS morans_i, round(e, 6) AS expected_i, round((i - e) / sqrt(var), 6) AS z_score, round(links / n, 6) AS mean_neighbors FROM f""")
def compare_spatial_weights(spark, sf_dir):
    return rounded(N.compare_spatial_weights(_suppliers(spark, sf_dir), ["v"], _METHODS).drop("p_value"), "morans_i", "expected_i", "z_score", "mean_neighbors")


@query(f"""WITH {_S}, {_SP}, z AS (SELECT fid, v - avg(v) OVER () AS z FROM s), q AS (SELECT count(*)::DOUBLE AS n, sum(z ** 2) AS m2, sum(z ** 4) AS m4 FROM z), b AS (SELECT unnest([300.0, 450.0, 600.0]::DOUBLE[]) AS r0),
 k AS (SELECT r0, i, count(*)::DOUBLE AS k, sum(a.z * b.z) AS c FROM b JOIN p ON d <= r0 JOIN z a ON a.fid = i JOIN z b ON b.fid = j GROUP BY r0, i), g AS (SELECT r0, sum(k) AS s0, 4 * sum(k * k) AS s2, sum(c) AS c FROM k GROUP BY r0),
 f AS (SELECT r0, n, n / s0 * c / m2 AS i, -1 / (n - 1) AS e, (n * ((n * n - 3 * n + 3) * 2 * s0 - n * s2 + 3 * s0 * s0) - n * m4 / (m2 * m2) * ((n * n - n) * 2 * s0 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1 / (n - 1) ** 2 AS var FROM g, q)
 SELECT r0 AS distance, round(i, 6) AS morans_i, round(e, 6) AS expected_i, round(var, 6) AS variance, round(CASE WHEN var > 0 THEN (i - e) / sqrt(var) END, 6) AS z_score FROM f""")
def incremental_spatial_autocorrelation(spark, sf_dir):
    return rounded(N.incremental_spatial_autocorrelation(_suppliers(spark, sf_dir), "v", 300.0, 150.0, 3).drop("p_value"), "morans_i", "expected_i", "variance", "z_score")


@query(f"""WITH {_S}, {_SP}, m AS (SELECT count(*)::DOUBLE AS n, sum(v) AS a, sum(v ** 2) AS b, sum(v ** 3) AS c, sum(v ** 4) AS d FROM s), w AS (SELECT i, j FROM p WHERE d <= 350), k AS (SELECT i, count(*)::DOUBLE AS k FROM w GROUP BY i),
 t AS (SELECT sum(k) AS s0, 2 * sum(k) AS s1, 4 * sum(k * k) AS s2 FROM k), g AS (SELECT sum(x.v * y.v) AS g FROM w JOIN s x ON x.fid = i JOIN s y ON y.fid = j),
 f AS (SELECT g / (a * a - b) AS g, s0 / (n * (n - 1)) AS e, (((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) * b * b - ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0) * d - (2 * n * s1 - (n + 3) * s2 + 6 * s0 * s0) * a * a * b
  + (4 * (n - 1) * s1 - 2 * (n + 1) * s2 + 8 * s0 * s0) * a * c + (s1 - s2 + s0 * s0) * a ** 4) / ((a * a - b) ** 2 * n * (n - 1) * (n - 2) * (n - 3)) - (s0 / (n * (n - 1))) ** 2 AS var FROM m, t, g), z AS (SELECT *, CASE WHEN var > 0 THEN (g - e) / sqrt(var) END AS z FROM f)
 SELECT round(g, 6) AS observed_g, round(e, 6) AS expected_g, round(var, 9) AS variance, round(z, 5) AS z_score, CASE WHEN z IS NULL THEN 'undetermined' WHEN abs(z) < 1.959963984540054 THEN 'random' WHEN z > 0 THEN 'high_clustering' ELSE 'low_clustering' END AS pattern FROM z""")
def getis_ord_general_g(spark, sf_dir):
    out = rounded(N.getis_ord_general_g(_suppliers(spark, sf_dir), "v", 350.0).drop("p_value"), "observed_g", "expected_g")
    return out.withColumn("variance", F.round("variance", 9)).withColumn("z_score", F.round("z_score", 5))


@query(f"""WITH {_S}, {_SP}, n AS (SELECT * FROM r WHERE r <= 5), u AS (SELECT i, count(*) AS nbr_count, avg(v) AS m, quantile_cont(v, 0.5) AS q, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi, sum(v) AS t FROM n GROUP BY i),
 h AS (SELECT i, count(*) AS nbr_count, sum(v / d) / sum(1 / d) AS m, quantile_cont(v, 0.5) AS q, sqrt(sum(v * v / d) / sum(1 / d) - (sum(v / d) / sum(1 / d)) ** 2) AS s, min(v) AS lo, max(v) AS hi, sum(v) AS t FROM p WHERE d <= 400 GROUP BY i)
 SELECT fid, nbr_count, round(m, 5) AS v_nbr_mean, q AS v_nbr_median, round(s, 5) AS v_nbr_std, lo AS v_nbr_min, hi AS v_nbr_max, t AS v_nbr_sum, 'knn' AS kind FROM s JOIN u ON i = fid
 UNION ALL SELECT fid, coalesce(nbr_count, 0), round(h.m, 5), h.q, round(h.s, 5), lo, hi, coalesce(t, 0), 'band' FROM s LEFT JOIN h ON i = fid""")
def neighborhood_summary_statistics(spark, sf_dir):
    rows = _suppliers(spark, sf_dir)
    near = N.neighborhood_summary_statistics(rows, ["v"], 5).withColumn("kind", F.lit("knn"))
    both = near.unionByName(N.neighborhood_summary_statistics(rows, ["v"], distance=400.0, weights="inverse_distance").withColumn("kind", F.lit("band"))).drop("x", "y", "v")
    return both.withColumn("v_nbr_mean", F.round("v_nbr_mean", 5)).withColumn("v_nbr_std", F.round("v_nbr_std", 5))


@query(f"""WITH {_C}, h AS (SELECT fid, x, y, CASE WHEN fid % 4 <> 0 THEN v END AS v, CAST(fid * 7 % 90 AS DOUBLE) AS t FROM s), p AS (SELECT a.fid AS i, a.t AS t0, b.v, b.t, {_DIST} AS d, b.fid AS j FROM h a, h b WHERE a.v IS NULL AND b.v IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM p),
 m AS (SELECT i, avg(v) AS f FROM r WHERE r <= 4 GROUP BY i), q AS (SELECT i, quantile_cont(v, 0.5) AS f FROM p WHERE d <= 90 AND abs(t - t0) <= 30 GROUP BY i), l AS (SELECT i, avg(v) + coalesce(CASE WHEN var_pop(t) > 0 THEN covar_pop(t, v) / var_pop(t) END * (any_value(t0) - avg(t)), 0) AS f FROM r WHERE r <= 6 GROUP BY i)
 SELECT fid, round(coalesce(v, f), 5) AS v, CAST(v IS NULL AND f IS NOT NULL AS BIGINT) AS filled, 'mean' AS kind FROM h LEFT JOIN m ON i = fid UNION ALL SELECT fid, round(coalesce(v, f), 5), CAST(v IS NULL AND f IS NOT NULL AS BIGINT), 'median' FROM h LEFT JOIN q ON i = fid
 UNION ALL SELECT fid, round(coalesce(v, f), 5), CAST(v IS NULL AND f IS NOT NULL AS BIGINT), 'trend' FROM h LEFT JOIN l ON i = fid""")
def fill_missing_values(spark, sf_dir):
    rows = _customers(spark, sf_dir).withColumn("v", F.when(F.col("fid") % 4 != 0, F.col("v"))).withColumn("t", ((F.col("fid") * 7) % 90).cast("double"))
    made = [
        N.fill_missing_values(rows, "v", k=4).withColumn("kind", F.lit("mean")),
        N.fill_missing_values(rows, "v", "median", radius=90.0, time="t", window=30.0).withColumn("kind", F.lit("median")),
        N.fill_missing_values(rows, "v", "temporal_trend", k=6, time="t").withColumn("kind", F.lit("trend")),
    ]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("fid", F.round("v", 5).alias("v"), "filled", "kind")


@query(f"""WITH {_C}, {_SP}, n AS (SELECT i, j, d FROM r WHERE r <= 10), k AS (SELECT i, max(d) AS k FROM n GROUP BY i), l AS (SELECT n.i, count(*) / sum(greatest(d, k)) AS l FROM n JOIN k ON k.i = j GROUP BY n.i),
 f AS (SELECT n.i AS fid, avg(b.l / a.l) AS lof FROM n JOIN l a ON a.i = n.i JOIN l b ON b.i = j GROUP BY n.i), c AS (SELECT lof AS c FROM (SELECT lof, row_number() OVER (ORDER BY lof DESC, fid) AS r, count(*) OVER () AS m FROM f) WHERE r = ceil(0.05::DOUBLE * m))
 SELECT fid, round(lof, 6) AS lof, CAST(round(lof, 9) >= round(c, 9) AS BIGINT) AS is_outlier FROM f, c""")
def spatial_outlier_detection(spark, sf_dir):
    return rounded(N.spatial_outlier_detection(_customers(spark, sf_dir), 10, 5.0).select("fid", "lof", "is_outlier"), "lof")


@query(f"""WITH {_C}, q AS (SELECT count(*)::DOUBLE AS n, avg(v) AS m, stddev_pop(v) AS s FROM s), w AS (SELECT a.fid, a.v, count(b.fid)::DOUBLE AS w, sum(b.v) AS x FROM s a JOIN s b ON {_DIST} <= 110 GROUP BY ALL), z AS (SELECT fid, v, n, (x - m * w) / (s * sqrt((n * w - w * w) / (n - 1))) AS z FROM w, q),
 p AS (SELECT *, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * ({_ALPHA}) AS p FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z)), r AS (SELECT *, row_number() OVER (ORDER BY p, fid) AS k FROM p),
 c AS (SELECT coalesce(max(p) FILTER (p <= k / n * 0.01), -1) AS c1, coalesce(max(p) FILTER (p <= k / n * 0.05), -1) AS c5, coalesce(max(p) FILTER (p <= k / n * 0.1), -1) AS c10 FROM r)
 SELECT fid, v AS "VALUE", round(z, 6) + 0.0::DOUBLE AS "GiZScore", round(p, 6) AS "GiPValue", CAST(CASE WHEN z >= 0 THEN 1 ELSE -1 END * CASE WHEN p <= c1 THEN 3 WHEN p <= c5 THEN 2 WHEN p <= c10 THEN 1 ELSE 0 END AS BIGINT) AS "Gi_Bin" FROM r, c""")
def optimized_hot_spot_analysis(spark, sf_dir):
    return rounded(N.hot_spots(_customers(spark, sf_dir), "v", 110.0), "GiZScore", "GiPValue")


@query(f"""WITH RECURSIVE {_C}, l AS (SELECT a.fid AS a, b.fid AS b FROM s a JOIN s b ON a.fid <> b.fid AND a.g = b.g AND {_DIST} <= 45), r AS (SELECT fid AS id, fid AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id AND r.root < l.b),
 c AS (SELECT id, min(root) AS root FROM r GROUP BY id) SELECT id AS fid, dense_rank() OVER (ORDER BY root) - 1 AS "GROUP_ID" FROM c""")
def group_by_proximity(spark, sf_dir):
    return P.group_by_proximity(_customers(spark, sf_dir), 45.0, "g").select("fid", "GROUP_ID")


@query(f"""WITH {_A}, {_B}, d AS (SELECT unnest([80.0, 200.0]::DOUBLE[]) AS distance), p AS (SELECT b.fid AS i, distance, a.link FROM b, a, d WHERE {_DIST} <= distance)
 SELECT CAST(fid AS VARCHAR) AS input_id, d.distance, count(p.i) AS count, coalesce(CAST(sum(p.link) AS DOUBLE), 0) AS sum_link, round(coalesce(avg(p.link), 0), 6) AS mean_link FROM b CROSS JOIN d LEFT JOIN p ON p.i = fid AND p.distance = d.distance GROUP BY fid, d.distance""")
def summarize_nearby(spark, sf_dir):
    a = _points(spark, sf_dir, "customer", "c_custkey", F.col("c_nationkey").alias("link"))
    return rounded(P.summarize_nearby(_points(spark, sf_dir, "supplier", "s_suppkey"), a, [80.0, 200.0], ["link"]), "mean_link")


@query(f"""WITH {_A}, {_B}, r AS (SELECT a.fid AS i, b.fid AS j, {_DIST} AS d, row_number() OVER (PARTITION BY a.fid ORDER BY {_DIST}, b.fid) AS k FROM a, b)
 SELECT i AS in_fid, j AS near_fid, round(d, 6) AS near_dist, k AS near_rank FROM r WHERE k <= 2""")
def generate_near_table_unbounded(spark, sf_dir):
    out = P.generate_near_table(_points(spark, sf_dir, "customer", "c_custkey"), _points(spark, sf_dir, "supplier", "s_suppkey"), closest_count=2)
    return rounded(out.select("in_fid", "near_fid", "near_dist", "near_rank"), "near_dist")
