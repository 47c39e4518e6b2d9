"""Registered queries of the geometry operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import proximity as P
from .proximity import _points, _sql
from .registry import query, read, rounded

#: Vertices of the lines that the events of a user make.
_E = _sql("e0", "events", "event_id", ", user_id, ts")
_V = f"{_E}, v AS (SELECT CAST(user_id AS VARCHAR) AS user_id, x, y, row_number() OVER w AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM e0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, fid) QUALIFY n > 1)"


def _lines(spark, sf_dir):
    return P.points_to_line(_points(spark, sf_dir, "events", "event_id", "user_id", "ts"), "user_id", "ts", "x", "y", "fid").select("user_id", "path")


def _vertices(df, *more):
    return df.select("user_id", F.posexplode("path").alias("pos", "p")).select("user_id", (F.col("pos") + 1).cast("long").alias("pos"), "p.x", "p.y", *more)


@query(f"""WITH {_V}, b AS (SELECT (min(x) + max(x)) / 2 AS ax, (min(y) + max(y)) / 2 AS ay FROM v), m AS (SELECT user_id, pos, (x - ax) * 2 AS dx, (y - ay) * -0.5::DOUBLE AS dy, ax, ay FROM v, b)
 SELECT user_id, pos, round(cos(radians(30)) * dx - sin(radians(30)) * dy + ax + 10, 5) AS x, round(sin(radians(30)) * dx + cos(radians(30)) * dy + ay - 5, 5) AS y FROM m""")
def transform_features(spark, sf_dir):
    out = _vertices(G.transform_features(_lines(spark, sf_dir), 10.0, -5.0, 30.0, 2.0, 0.5, "X"))
    return out.withColumn("x", F.round("x", 5)).withColumn("y", F.round("y", 5))


@query(f"WITH {_V} SELECT user_id, n - pos + 1 AS pos, x, y FROM v")
def flip_line(spark, sf_dir):
    return _vertices(G.flip_line(_lines(spark, sf_dir)))


@query(f"""WITH {_V}, l AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM v WINDOW w AS (PARTITION BY user_id ORDER BY pos)), c AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM l WHERE dx IS NOT NULL),
 t AS (SELECT *, sum(len) OVER (PARTITION BY user_id ORDER BY pos) AS cum, sum(len) OVER (PARTITION BY user_id) / 2 AS half FROM c), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k FROM t WHERE cum >= half - 1e-9),
 z AS (SELECT x, y FROM v WHERE pos IN (1, n) GROUP BY x, y HAVING count(*) = 1)
 SELECT user_id, x, y, 'ALL' AS location FROM v UNION ALL SELECT user_id, x, y, 'START' FROM v WHERE pos = 1 UNION ALL SELECT user_id, x, y, 'END' FROM v WHERE pos = n UNION ALL SELECT user_id, x, y, 'BOTH_ENDS' FROM v WHERE pos IN (1, n)
 UNION ALL SELECT user_id, x, y, 'DANGLE' FROM v JOIN z USING (x, y) WHERE pos IN (1, n) UNION ALL SELECT user_id, round(CASE WHEN len > 0 THEN x + dx * (half - cum + len) / len ELSE x END, 4), round(CASE WHEN len > 0 THEN y + dy * (half - cum + len) / len ELSE y END, 4), 'MID' FROM m WHERE k = 1""")
def feature_vertices_to_points(spark, sf_dir):
    lines, out = _lines(spark, sf_dir), None
    for k in ("ALL", "START", "END", "BOTH_ENDS", "DANGLE", "MID"):
        part = G.feature_vertices_to_points(lines, k).select("user_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.lit(k).alias("location"))
        out = part if out is None else out.union(part)
    return out


@query("""SELECT p_partkey, round(p_retailprice * 0.3048 * 2 + 5, 6) AS z FROM part""")
def adjust_3d_z(spark, sf_dir):
    one = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("p_retailprice").cast("double").alias("z"))
    out = G.adjust_3d_z(read(spark, sf_dir, "part").select("p_partkey", F.array(one).alias("path")), 2.0, 5.0, "feet")
    return rounded(out.select("p_partkey", F.element_at("path", 1)["z"].alias("z")), "z")


@query("""SELECT o_orderkey, round(CAST(o_custkey % 100 AS DOUBLE) + o_totalprice * sin(radians(o_orderkey % 360)), 4) + 0.0::DOUBLE AS x, round(CAST(o_custkey % 50 AS DOUBLE) + o_totalprice * cos(radians(o_orderkey % 360)), 4) + 0.0::DOUBLE AS y, 'bearing_distance' AS mode FROM orders
 UNION ALL SELECT o_orderkey, CAST(o_orderkey % 360 AS DOUBLE), o_totalprice, 'xy_to_line' FROM orders""")
def table_to_geometry(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("x"), (F.col("o_custkey") % 50).alias("y"), (F.col("o_orderkey") % 360).alias("bearing"), F.col("o_totalprice").alias("distance"))
    made = [G.table_to_geometry(rows, "bearing_distance"), G.table_to_geometry(rows, "xy_to_line", start_x="x", start_y="y", end_x="bearing", end_y="distance")]
    ends = [df.select("o_orderkey", F.element_at("path", -1)["x"].alias("x"), F.element_at("path", -1)["y"].alias("y"), F.lit(m).alias("mode")) for df, m in zip(made, ("bearing_distance", "xy_to_line"))]
    return ends[0].withColumn("x", F.round("x", 4) + 0.0).withColumn("y", F.round("y", 4) + 0.0).union(ends[1])


#: Positions from keys, over most of the globe.
_GEO = "p AS (SELECT c_custkey AS fid, c_custkey * 37 % 359 - 179 + 0.123456::DOUBLE AS lon, c_custkey * 91 % 163 - 80 + 0.345678::DOUBLE AS lat FROM customer)"


def _geo(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("fid"), ((k * 37) % 359 - 179 + 0.123456).cast("double").alias("lon"), ((k * 91) % 163 - 80 + 0.345678).cast("double").alias("lat"))


@query(f"""WITH {_GEO}, z AS (SELECT fid, lat, CASE WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 ELSE CAST(floor((lon + 180) / 6) AS INT) + 1 END AS z FROM p)
 SELECT fid, CAST(z AS BIGINT) AS utm_zone, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + z AS BIGINT) AS utm_epsg FROM z""")
def calculate_utm_zone(spark, sf_dir):
    return G.calculate_utm_zone(_geo(spark, sf_dir)).select("fid", "utm_zone", "utm_epsg")


@query(f"""WITH {_GEO}, a AS (SELECT fid, degrees(atan(tan(radians(lon - (floor((lon + 180) / 6) * 6 + 3 - 180))) * sin(radians(lat)))) AS g, degrees(atan(tan(radians(lon - 10)) * sin(radians(lat)))) AS h FROM p)
 SELECT fid, round(g, 6) + 0.0::DOUBLE AS convergence, round(90 - h, 6) + 0.0::DOUBLE AS arithmetic FROM a""")
def calculate_grid_convergence_angle(spark, sf_dir):
    out = G.calculate_grid_convergence_angle(G.calculate_grid_convergence_angle(_geo(spark, sf_dir)), "arithmetic", "arithmetic", 10.0)
    return rounded(out.select("fid", "convergence", "arithmetic"), "convergence", "arithmetic")


@query(f"""WITH {_GEO}, g AS (SELECT fid % 40 AS line, min(lon) AS a, max(lon) AS b, min(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) AS c, max(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) AS d, min(lat) AS s, max(lat) AS n FROM p GROUP BY 1), m AS (SELECT *, CASE WHEN b - a > 180 AND b - a < 360 AND d - c < b - a THEN (c + d) / 2 ELSE (a + b) / 2 END AS m FROM g)
 SELECT line, round(CASE WHEN m >= 180 THEN m - 360 ELSE m END, 6) AS central_meridian, round(s + (n - s) * 0.25, 6) AS standard_parallel_1, round(n - (n - s) * 0.25, 6) AS standard_parallel_2 FROM m""")
def calculate_central_meridian_and_parallels(spark, sf_dir):
    lines = _geo(spark, sf_dir).groupBy((F.col("fid") % 40).alias("line")).agg(F.collect_list(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("path"))
    return rounded(G.calculate_central_meridian_and_parallels(lines).drop("path"), "central_meridian", "standard_parallel_1", "standard_parallel_2")


def _axis(c: str, width: int, sides: str) -> str:
    a, side = f"abs({c})", f"CASE WHEN {c} >= 0 THEN '{sides[0]}' ELSE '{sides[1]}' END"
    m = f"(({a} - floor({a})) * 60)"
    return f"printf('%0{width}d°%02d''%06.3f\"%s', CAST(floor({a}) AS INT), CAST(floor({m}) AS INT), ({m} - floor({m})) * 60, {side}) AS dms_{c}, printf('%0{width}d°%06.3f''%s', CAST(floor({a}) AS INT), {m}, {side}) AS ddm_{c}"


@query(f"""WITH {_GEO}, n AS (SELECT fid, {_axis("lat", 2, "NS")}, {_axis("lon", 3, "EW")}, printf('%.8f, %.8f', lat, lon) AS dd FROM p) SELECT fid, dms_lat || ' ' || dms_lon AS dms, ddm_lat || ' ' || ddm_lon AS ddm, dd FROM n""")
def convert_coordinate_notation(spark, sf_dir):
    out = _geo(spark, sf_dir)
    for n in ("DMS", "DDM", "DD"):
        out = G.convert_coordinate_notation(out, n, n.lower())
    return out.select("fid", "dms", "ddm", "dd")


@query("SELECT c_custkey AS fid, CAST(3857 AS BIGINT) AS crs_epsg FROM customer")
def assign_projection_vector(spark, sf_dir):
    return G.assign_projection(_geo(spark, sf_dir), 3857).select("fid", "crs_epsg")


_Y = "least(greatest(CAST(floor((1 - asinh(tan(radians({}))) / pi()) / 2 * n) AS BIGINT), 0), CAST(n AS BIGINT) - 1)"


@query(f"""WITH {_GEO}, e AS (SELECT z, 2.0::DOUBLE ** z AS n, min(lon) AS a, max(lon) AS b, min(lat) AS s, max(lat) AS t FROM p, range(2, 4) r(z) GROUP BY z), x AS (SELECT z, n, unnest(range(CAST(floor((a + 180) / 360 * n) AS BIGINT), CAST(floor((b + 180) / 360 * n) AS BIGINT) + 1)) AS x, {_Y.format("t")} AS y0, {_Y.format("s")} AS y1 FROM e),
 y AS (SELECT z, n, x, unnest(range(y0, y1 + 1)) AS y FROM x) SELECT z, x, y, array_to_string(list_transform(range(z - 1, -1, -1), lambda i: CAST((x >> i) % 2 + 2 * ((y >> i) % 2) AS VARCHAR)), '') AS quadkey, z || '/' || x || '/' || y AS tile_id,
 round(x / n * 360 - 180, 6) + 0.0::DOUBLE AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / n)))), 6) + 0.0::DOUBLE AS south, round((x + 1) / n * 360 - 180, 6) + 0.0::DOUBLE AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / n)))), 6) + 0.0::DOUBLE AS north FROM y""")
def tile_grid_polygons(spark, sf_dir):
    return rounded(G.tile_grid_polygons(_geo(spark, sf_dir), 2, 3), "west", "south", "east", "north")
