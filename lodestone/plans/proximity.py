"""Registered queries of the proximity and route operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import proximity as P
from .registry import query, read, rounded


def _points(spark, sf_dir, table, key, *more):
    """A table's rows as points whose coordinates come from their keys."""
    k = F.col(key)
    return read(spark, sf_dir, table).select(
        k.alias("fid"), ((k * 37) % 1009).cast("double").alias("x"), ((k * 91) % 1013).cast("double").alias("y"), *more
    )


def _sql(name, table, key, more=""):
    return f"{name} AS (SELECT {key} AS fid, CAST({key} * 37 % 1009 AS DOUBLE) AS x, CAST({key} * 91 % 1013 AS DOUBLE) AS y{more} FROM {table})"


_A, _B = _sql("a", "customer", "c_custkey", ", c_nationkey AS link"), _sql("b", "supplier", "s_suppkey", ", s_nationkey AS link")
_DIST = "sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)"


@query(f"""WITH {_A}, {_B}, p AS (SELECT a.fid AS i, b.fid AS n, {_DIST} AS d, b.x, b.y, degrees(atan2(b.y - a.y, b.x - a.x)) AS angle FROM a, b WHERE {_DIST} <= 120), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, n) AS k FROM p)
 SELECT i AS in_fid, n AS near_fid, round(d, 6) AS near_dist, k AS near_rank, x AS near_x, y AS near_y, round(angle, 6) + 0.0::DOUBLE AS near_angle FROM r WHERE k <= 3""")
def generate_near_table(spark, sf_dir):
    out = P.generate_near_table(_points(spark, sf_dir, "customer", "c_custkey"), _points(spark, sf_dir, "supplier", "s_suppkey"), 120.0, 3)
    return rounded(out, "near_dist", "near_angle")


@query(f"""WITH {_A}, {_B}, p AS (SELECT a.fid AS o, b.fid AS d, {_DIST} AS n, a.link FROM a JOIN b ON a.link = b.link), r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n, d) AS k FROM p)
 SELECT o AS origin_id, d AS dest_id, round(n, 6) AS length, link AS link_id, 'nearest' AS kind FROM r WHERE k <= 2 UNION ALL SELECT o, d, round(n, 6), link, 'radius' FROM p WHERE n <= 300""")
def generate_od_links(spark, sf_dir):
    a = _points(spark, sf_dir, "customer", "c_custkey", F.col("c_nationkey").alias("link"))
    b = _points(spark, sf_dir, "supplier", "s_suppkey", F.col("s_nationkey").alias("link"))
    nearest = P.generate_od_links(a, b, by_link=True, num_nearest=2).withColumn("kind", F.lit("nearest"))
    return rounded(nearest.unionByName(P.generate_od_links(a, b, 300.0, True).withColumn("kind", F.lit("radius"))), "length")


_T = ", CAST(floor(epoch(ts)) AS DOUBLE) AS t, event_type"


@query(f"""WITH {_sql("e", "events", "event_id", _T)}, a AS (SELECT * FROM e WHERE event_type = 'error'), b AS (SELECT * FROM e WHERE event_type = 'purchase'), p AS (SELECT a.fid AS i, b.fid AS j, {_DIST} AS d, b.t - a.t AS dt FROM a JOIN b ON abs(b.t - a.t) <= 36000 WHERE {_DIST} <= 150)
 SELECT i AS primary_id, j AS secondary_id, round(d, 6) AS distance, dt AS delta_t, 'within' AS relation FROM p UNION ALL SELECT i, j, round(d, 6), dt, 'before' FROM p WHERE dt <= 0 UNION ALL SELECT i, j, round(d, 6), dt, 'after' FROM p WHERE dt >= 0""")
def find_space_time_matches(spark, sf_dir):
    e = _points(spark, sf_dir, "events", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"), "event_type")
    a, b = (e.where(F.col("event_type") == k) for k in ("error", "purchase"))
    both = P.find_space_time_matches(a, b, 150.0, 36000.0)
    # The matches before and after are those within of that sign, so the tables meet once.
    before, after, when = ([F.lit(k) for k in ks] for ks in (("within", "before"), ("within", "after"), ("within", "before", "after")))
    kinds = F.when(F.col("delta_t") < 0, F.array(*before)).when(F.col("delta_t") > 0, F.array(*after)).otherwise(F.array(*when))
    return rounded(both.withColumn("relation", F.explode(kinds)), "distance")


@query(f"""WITH {_sql("e", "events", "event_id", ", user_id, ts")}, s AS (SELECT user_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, fid)),
 g AS (SELECT user_id, count(*) AS n, coalesce(sum(d), 0) AS l FROM s GROUP BY 1 HAVING count(*) > 1), c AS (SELECT e.user_id, sqrt((arg_max(x, {{'t': ts, 'f': fid}}) - arg_min(x, {{'t': ts, 'f': fid}})) ** 2 + (arg_max(y, {{'t': ts, 'f': fid}}) - arg_min(y, {{'t': ts, 'f': fid}})) ** 2) AS d FROM e GROUP BY 1)
 SELECT CAST(user_id AS VARCHAR) AS user_id, n AS point_count, round(l, 6) AS length, 'open' AS kind FROM g UNION ALL SELECT CAST(g.user_id AS VARCHAR), n + CAST(d > 0 AS BIGINT), round(l + d, 6), 'closed' FROM g JOIN c USING (user_id)""")
def points_to_line(spark, sf_dir):
    e = _points(spark, sf_dir, "events", "event_id", "user_id", "ts")
    made = [P.points_to_line(e, "user_id", "ts", "x", "y", "fid", close).drop("path").withColumn("kind", F.lit("closed" if close else "open")) for close in (False, True)]
    return rounded(made[0].union(made[1]), "length")


_EV = "e AS (SELECT o_custkey % 40 AS route, o_orderkey, CAST(o_orderkey * 17 % 4000 AS DOUBLE) AS m0, CAST(o_orderkey * 17 % 4000 + o_custkey % 30 - 10 AS DOUBLE) AS m1, o_orderstatus FROM orders), s AS (SELECT route, o_orderkey, o_orderstatus, least(m0, m1) AS lo, greatest(m0, m1) AS hi FROM e)"


@query(f"""WITH {_EV}, n AS (SELECT *, CAST(coalesce(lo > max(hi) OVER (PARTITION BY route, o_orderstatus ORDER BY lo, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2, true) AS INT) AS b FROM s), p AS (SELECT *, sum(b) OVER (PARTITION BY route, o_orderstatus ORDER BY lo, o_orderkey ROWS UNBOUNDED PRECEDING) AS p FROM n)
 SELECT route, min(lo) AS m0, max(hi) AS m1, o_orderstatus, count(*) AS "EVENT_COUNT" FROM p GROUP BY route, o_orderstatus, p""")
def dissolve_route_events(spark, sf_dir):
    return P.dissolve_route_events(_events(spark, sf_dir), "route", "m0", "m1", ["o_orderstatus"], "o_orderkey", 2.0)


@query(f"""WITH {_EV}, n AS (SELECT *, CAST(coalesce(lo > max(hi) OVER (PARTITION BY route ORDER BY lo, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS INT) AS b FROM s), p AS (SELECT *, sum(b) OVER (PARTITION BY route ORDER BY lo, o_orderkey ROWS UNBOUNDED PRECEDING) AS p FROM n),
 f AS (SELECT *, row_number() OVER (PARTITION BY route, p, o_orderstatus ORDER BY lo, o_orderkey) AS k FROM p)
 SELECT route, min(lo) AS m0, max(hi) AS m1, string_agg(o_orderstatus, ',' ORDER BY lo, o_orderkey) FILTER (k = 1) AS o_orderstatus, count(*) AS "EVENT_COUNT" FROM f GROUP BY route, p""")
def dissolve_route_events_concatenate(spark, sf_dir):
    return P.dissolve_route_events(_events(spark, sf_dir), "route", "m0", "m1", ["o_orderstatus"], "o_orderkey", mode="concatenate")


def _events(spark, sf_dir):
    start = ((F.col("o_orderkey") * 17) % 4000).cast("double")
    return read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("route"), "o_orderkey", start.alias("m0"), (start + F.col("o_custkey") % 30 - 10).alias("m1"), "o_orderstatus"
    )
