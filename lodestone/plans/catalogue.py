"""Registered queries of the table and track operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import table as T
from ..operators import tracks as K
from .registry import ORACLE_SQL, QUERIES
from .registry import query as _query
from .registry import read as _read
from .registry import rounded as _rounded

def _fixes(spark, sf_dir):
    """Events as fixes: planar coordinates from their ids, time in seconds."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "value", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"),
        ((F.col("event_id") * 37) % 1000).cast("double").alias("x"), ((F.col("event_id") * 91) % 1000).cast("double").alias("y"),
    )


FIXES = """e AS (SELECT event_id, user_id, value, CAST(floor(epoch(ts)) AS DOUBLE) AS t,
 CAST(event_id * 37 % 1000 AS DOUBLE) AS x, CAST(event_id * 91 % 1000 AS DOUBLE) AS y FROM events)"""


@_query("""SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 6) AS l_quantity_sum, round(avg(l_extendedprice), 6) AS l_extendedprice_mean,
 min(l_discount) AS l_discount_min, max(l_tax) AS l_tax_max, round(stddev_samp(l_quantity), 6) AS l_quantity_std FROM lineitem GROUP BY ALL""")
def summary_statistics(spark, sf_dir):
    stats = [("l_quantity", "sum"), ("l_extendedprice", "mean"), ("l_discount", "min"), ("l_tax", "max"), ("l_quantity", "std")]
    out = T.summary_statistics(_read(spark, sf_dir, "lineitem"), stats, ["l_returnflag", "l_linestatus"])
    return _rounded(out, "l_quantity_sum", "l_extendedprice_mean", "l_quantity_std")


@_query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def pivot_table(spark, sf_dir):
    out = T.pivot_table(_read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", "o_orderkey", "count")
    for c in "FOP":
        out = out if c in out.columns else out.withColumn(c, F.lit(0).cast("long"))
    return out.select("o_orderpriority", "F", "O", "P")


@_query("""SELECT p_partkey, 'p_size' AS FIELD, CAST(p_size AS DOUBLE) AS VALUE FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def transpose_fields(spark, sf_dir):
    return T.transpose_fields(_read(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["p_partkey"])


@_query("""SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (ORDER BY c_mktsegment NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey) AS rank FROM customer""")
def sort_features(spark, sf_dir):
    df = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return T.sort_features(df, [("c_mktsegment", True), ("c_acctbal", False)], "c_custkey", "rank")


@_query("""SELECT p_partkey, p_brand, p_size, dense_rank() OVER (ORDER BY f) - 1 AS dup_group, dup_seq FROM (SELECT p_partkey, p_brand, p_size,
 min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS f, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS dup_seq FROM part)""")
def find_identical(spark, sf_dir):
    return T.find_identical(_read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"], "p_partkey")


@_query("""WITH b AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS b FROM orders)
 SELECT o_orderkey, CAST(1 + len(list_filter(b, lambda c: o_totalprice > c)) AS BIGINT) AS class FROM orders, b""")
def reclassify_field(spark, sf_dir):
    return T.reclassify_field(_read(spark, sf_dir, "orders"), "o_totalprice", "quantile", classes=5).select("o_orderkey", "class")


@_query("""SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER (), 6) AS s_acctbal_z FROM supplier""")
def transform_fields(spark, sf_dir):
    return _rounded(T.transform_fields(_read(spark, sf_dir, "supplier"), ["s_acctbal"], "zscore").select("s_suppkey", "s_acctbal_z"), "s_acctbal_z")


@_query("""WITH s AS (SELECT p_partkey, (p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE) AS a,
 (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS b FROM part), i AS (SELECT *, (a * 1.0::DOUBLE + b * 1.0::DOUBLE) / 2 AS i FROM s),
 r AS (SELECT *, row_number() OVER (ORDER BY i DESC, p_partkey) AS k FROM i)
 SELECT p_partkey, round(a, 6) AS p_size_scaled, round(b, 6) AS p_retailprice_scaled, round(i, 6) AS "index", k AS index_rank, round(100.0::DOUBLE * (1 - (k - 1) / CAST(count(*) OVER () - 1 AS DOUBLE)), 6) AS index_pctl FROM r""")
def calculate_composite_index(spark, sf_dir):
    out = T.calculate_composite_index(_read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "p_partkey")
    return _rounded(out.drop("p_size", "p_retailprice"), "p_size_scaled", "p_retailprice_scaled", "index", "index_pctl")


@_query("""WITH d AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS o, count(*) AS p FROM lineitem GROUP BY 1), g AS (SELECT sum(o) / sum(p)::DOUBLE AS m, sum(p)::DOUBLE AS sp, count(*) AS n FROM d),
 v AS (SELECT m, greatest(sum(p * (o / p::DOUBLE - m) ** 2) / any_value(sp) - m / (any_value(sp) / any_value(n)), 0) AS a FROM d, g GROUP BY m)
 SELECT l_suppkey, o, p, round(o / p::DOUBLE * 1000, 6) AS crude_rate, round((a / (a + m / p) * (o / p::DOUBLE) + (1 - a / (a + m / p)) * m) * 1000, 6) AS smooth_rate, round(sqrt(o) / p * 1000, 6) AS rate_se FROM d, v""")
def calculate_rates(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("o"), F.count("*").alias("p"))
    return _rounded(T.calculate_rates(df, "o", "p", 1000.0), "crude_rate", "smooth_rate", "rate_se")


@_query("""WITH z AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS a, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS b, p_brand FROM part),
 g AS (SELECT avg(a) AS ga, avg(b) AS gb FROM z WHERE p_partkey <= 3), s AS (SELECT p_partkey, sqrt((a - ga) ** 2 + (b - gb) ** 2) AS s FROM z, g WHERE p_partkey > 3)
 SELECT p_partkey, round(s, 6) AS sim_score, row_number() OVER (ORDER BY s, p_partkey) AS sim_rank FROM s ORDER BY s, p_partkey LIMIT 10""")
def similarity_search(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    out = T.similarity_search(part.where("p_partkey <= 3"), part.where("p_partkey > 3"), ["p_size", "p_retailprice"], "p_partkey")
    return _rounded(out.select("p_partkey", "sim_score", "sim_rank"), "sim_score")


_SCALED = "z AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS a, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS b FROM part), g AS (SELECT avg(a) AS ga, avg(b) AS gb FROM z WHERE p_partkey <= 3), s AS (SELECT p_partkey, (a * ga + b * gb) / (sqrt(a * a + b * b) * sqrt(ga * ga + gb * gb)) AS s FROM z, g WHERE p_partkey > 3)"


@_query(f"""WITH {_SCALED}, r AS (SELECT p_partkey, s, row_number() OVER (ORDER BY s DESC, p_partkey) AS most, row_number() OVER (ORDER BY s, p_partkey) AS least FROM s)
 SELECT round(s, 6) AS sim_score, most AS sim_rank, 'most' AS match FROM r WHERE most <= 10 UNION ALL SELECT round(s, 6), least, 'least' FROM r WHERE least <= 10""")
def similarity_search_cosine(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    out = T.similarity_search(part.where("p_partkey <= 3"), part.where("p_partkey > 3"), ["p_size", "p_retailprice"], "p_partkey", method="cosine", which="both")
    return _rounded(out.select("sim_score", "sim_rank", "match"), "sim_score")


@_query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
 SELECT c_custkey, c_mktsegment, k <= floor(0.3::DOUBLE * n + 0.5) AS training FROM r""")
def subset_features(spark, sf_dir):
    return T.subset_features(_read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 30.0, seed=7, group_field="c_mktsegment")


@_query("""WITH l AS (SELECT CAST(l_suppkey AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y, sum(l_quantity) AS incident_count FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rank, sum(incident_count) OVER w AS run, sum(incident_count) OVER () AS total FROM l WINDOW w AS (ORDER BY incident_count DESC, x, y ROWS UNBOUNDED PRECEDING))
 SELECT rank - 1 AS location_id, x, y, incident_count, rank, round(100 * run / total, 6) AS cumulative_pct, CASE WHEN 100 * (run - incident_count) / total < 80 THEN 'head' ELSE 'tail' END AS band FROM r""")
def eighty_twenty_analysis(spark, sf_dir):
    points = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"), "l_quantity")
    return _rounded(T.eighty_twenty_analysis(points, "x", "y", "l_quantity"), "cumulative_pct")


@_query("""WITH a AS (SELECT l_suppkey, avg(l_quantity) - 25.5 AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey, avg(l_quantity) - 25.5 AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
 c AS (SELECT l_suppkey, round(a.b, 6) AS bin1, round(b.b, 6) AS bin2, CASE WHEN abs(a.b) <= 0.2 THEN 'none' WHEN a.b > 0 THEN 'hot' ELSE 'cold' END AS cat1, CASE WHEN abs(b.b) <= 0.2 THEN 'none' WHEN b.b > 0 THEN 'hot' ELSE 'cold' END AS cat2 FROM a JOIN b USING (l_suppkey))
 SELECT *, cat1 || '_to_' || cat2 AS category, CAST(cat1 = cat2 AS BIGINT) AS agreement FROM c""")
def hot_spot_analysis_comparison(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg((F.avg("l_quantity") - 25.5).alias("bin"))
    first, second = (rows.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in "RA")
    return _rounded(T.hot_spot_analysis_comparison(first, second, "bin", "l_suppkey", 0.2), "bin1", "bin2")


@_query("""WITH f AS (SELECT s_suppkey, s_acctbal AS v, min(s_acctbal) OVER () AS lo, max(s_acctbal) OVER () AS hi, avg(s_acctbal) OVER () AS m, stddev_samp(s_acctbal) OVER () AS s, quantile_cont(s_acctbal, [0.25, 0.5, 0.75]) OVER () AS q FROM supplier),
 b AS (SELECT s_suppkey, [lo + (hi - lo) * 0.25, lo + (hi - lo) * 0.5, lo + (hi - lo) * 0.75] AS e, q, [m - s, m, m + s] AS d, v FROM f)
 SELECT s_suppkey, 1 + len(list_filter(e, lambda c: v > c)) AS s_acctbal_bin, 'equal_interval' AS method FROM b UNION ALL SELECT s_suppkey, 1 + len(list_filter(q, lambda c: v > c)), 'quantile' FROM b UNION ALL SELECT s_suppkey, 1 + len(list_filter(d, lambda c: v > c)), 'std_dev' FROM b""")
def transform_fields_bin(spark, sf_dir):
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    made = [T.transform_fields(rows, ["s_acctbal"], "bin", 4, m).select("s_suppkey", "s_acctbal_bin", F.lit(m).alias("method")) for m in ("equal_interval", "quantile", "std_dev")]
    return made[0].union(made[1]).union(made[2])


@_query("""SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS BIGINT) AS c_mktsegment_AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS c_mktsegment_BUILDING, CAST(c_mktsegment = 'MACHINERY' AS BIGINT) AS c_mktsegment_MACHINERY FROM customer""")
def transform_fields_onehot(spark, sf_dir):
    out = T.transform_fields(_read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "onehot")
    return out.select("c_custkey", "c_mktsegment_AUTOMOBILE", "c_mktsegment_BUILDING", "c_mktsegment_MACHINERY")


@_query("""SELECT p_partkey, round((pow(p_retailprice, 0.5) - 1) / 0.5, 6) AS p_retailprice_boxcox FROM part""")
def transform_fields_boxcox(spark, sf_dir):
    return _rounded(T.transform_fields(_read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], "boxcox", boxcox=0.5).select("p_partkey", "p_retailprice_boxcox"), "p_retailprice_boxcox")


@_query("""WITH s AS (SELECT p_partkey, (SELECT count(*) FROM part q WHERE q.p_size <= p.p_size) - 1 AS a, (SELECT count(*) FROM part q WHERE q.p_retailprice <= p.p_retailprice) - 1 AS b, (SELECT count(*) FROM part) - 1 AS m FROM part p),
 i AS (SELECT p_partkey, exp((ln(greatest(a / m::DOUBLE, 1e-9)) * 2.0 + ln(greatest(b / m::DOUBLE, 1e-9)) * 1.0) / 3.0) AS g FROM s), r AS (SELECT p_partkey, (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) * 100 AS g FROM i)
 SELECT p_partkey, round(g, 6) AS "index" FROM r""")
def calculate_composite_index_percentile(spark, sf_dir):
    out = T.calculate_composite_index(_read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "p_partkey", [2.0, 1.0], "percentile", "geometric_mean", "zero_to_100")
    return _rounded(out.select("p_partkey", "index"), "index")


@_query("""SELECT o_custkey, count(*) AS count, arg_min(c, o_orderkey) AS c_first, arg_max(c, o_orderkey) AS c_last FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS c FROM orders) WHERE c IS NOT NULL GROUP BY 1""")
def summary_statistics_first_last(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("c")).where("c IS NOT NULL")
    return T.summary_statistics(rows, [("c", "first"), ("c", "last")], ["o_custkey"], "o_orderkey")


@_query(f"WITH {FIXES} SELECT event_id, user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS end_time FROM e")
def calculate_end_time(spark, sf_dir):
    return T.calculate_end_time(_fixes(spark, sf_dir), "t", ["user_id"], "event_id").select("event_id", "user_id", "t", "end_time")


@_query("""WITH a AS (SELECT o_orderpriority AS km_stratum, floor(o_totalprice / 10000) AS t, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS d FROM orders GROUP BY ALL),
 r AS (SELECT *, sum(n) OVER (PARTITION BY km_stratum ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM a)
 SELECT km_stratum, t, CAST(risk AS BIGINT) AS risk, d, round(CASE WHEN max(CAST(d >= risk AS INT)) OVER w = 1 THEN 0.0::DOUBLE ELSE exp(sum(CASE WHEN d < risk THEN ln(1 - d / risk::DOUBLE) END) OVER w) END, 6) AS km_survival
 FROM r WHERE d > 0 WINDOW w AS (PARTITION BY km_stratum ORDER BY t)""")
def estimate_time_to_event(spark, sf_dir):
    df = _read(spark, sf_dir, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 10000).alias("age"), (F.col("o_orderstatus") == "F").cast("int").alias("e"))
    return _rounded(T.estimate_time_to_event(df, "age", "e", "o_orderpriority"), "km_survival")


_W = "WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)"
_D = "sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2)"


@_query(f"""WITH {FIXES}, d AS (SELECT event_id, row_number() OVER w - 1 AS seq, coalesce({_D}, 0) AS dist, coalesce(t - lag(t) OVER w, 0) AS dt, t - first(t) OVER w AS elapsed, user_id, t FROM e {_W}),
 s AS (SELECT *, CASE WHEN dt > 0 THEN dist / dt ELSE 0 END AS speed, sum(dist) OVER w AS cum FROM d {_W})
 SELECT event_id, seq, round(dist, 6) AS dist, dt, round(cum, 6) AS cum_dist, elapsed, round(speed, 6) AS speed, round(CASE WHEN dt > 0 AND seq > 0 THEN (speed - lag(speed) OVER w) / dt ELSE 0 END, 6) + 0.0::DOUBLE AS accel FROM s {_W}""")
def calculate_motion_statistics(spark, sf_dir):
    out = K.calculate_motion_statistics(_fixes(spark, sf_dir), "user_id", "t", "x", "y", "event_id")
    return _rounded(out.select("event_id", "seq", "dist", "dt", "cum_dist", "elapsed", "speed", "accel"), "dist", "cum_dist", "speed", "accel").withColumn("accel", F.col("accel") + 0.0)


@_query(f"""WITH {FIXES}, d AS (SELECT *, {_D} AS d, coalesce(t - lag(t) OVER w > 86400, false) AS cut FROM e {_W}), s AS (SELECT *, CAST(sum(CAST(cut AS BIGINT)) OVER w AS BIGINT) AS segment FROM d {_W}),
 g AS (SELECT user_id AS track_id, segment, count(*) AS n_points, min(t) AS start_t, max(t) AS end_t, coalesce(sum(CASE WHEN NOT cut THEN d END), 0) AS length FROM s GROUP BY ALL HAVING count(*) > 1)
 SELECT track_id, segment, n_points, start_t, end_t, end_t - start_t AS duration, round(length, 6) AS length, round(CASE WHEN end_t > start_t THEN length / (end_t - start_t) ELSE 0 END, 6) AS mean_speed FROM g""")
def reconstruct_tracks(spark, sf_dir):
    return _rounded(K.reconstruct_tracks(_fixes(spark, sf_dir), "user_id", "t", "x", "y", "event_id", time_gap=86400), "length", "mean_speed")


@_query(f"WITH {FIXES} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM e")
def time_series_smoothing(spark, sf_dir):
    return _rounded(K.time_series_smoothing(_fixes(spark, sf_dir), "value", "t", "user_id", "event_id").select("event_id", "smoothed"), "smoothed")


@_query(f"""WITH {FIXES}, f AS (SELECT *, coalesce(value > 50, false) AS c, coalesce(value > 50, false) AND NOT coalesce(lag(coalesce(value > 50, false)) OVER w, false) AS s FROM e {_W}),
 q AS (SELECT *, CAST(sum(CAST(s AS BIGINT)) OVER w AS BIGINT) AS incident_seq FROM f {_W})
 SELECT user_id AS track_id, incident_seq, count(*) AS n_points, min(t) AS start_t, max(t) AS end_t, max(t) - min(t) AS duration, row_number() OVER (ORDER BY user_id, incident_seq) AS incident_id FROM q WHERE c GROUP BY user_id, incident_seq""")
def detect_incidents(spark, sf_dir):
    return K.detect_incidents(_fixes(spark, sf_dir), "user_id", "t", "value > 50", "event_id")


@_query(f"WITH {FIXES} SELECT round(x / 50) AS kx, round(y / 50) AS ky, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y, count(*) AS ICOUNT FROM e GROUP BY 1, 2")
def collect_events(spark, sf_dir):
    return K.collect_events(_fixes(spark, sf_dir), "x", "y", "event_id", 50.0)


# These register theirs as they are imported.
from . import geometry, neighbors, proximity, rasters, regression, surfaces, zones  # noqa: E402, F401
