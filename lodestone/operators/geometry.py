"""Per-row geometry: lines as ``path``, an array of (x, y) or (x, y, z), and positions as lon and lat in degrees.

Everything is a column expression; only the centre of a layer's extent takes an aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres in a unit of height.
METRES = {"meters": 1.0, "feet": 0.3048, "us_feet": 1200 / 3937, "centimeters": 0.01, "millimeters": 0.001, "kilometers": 1000.0, "miles": 1609.344, "yards": 0.9144, "inches": 0.0254}


def transform_features(
    df: DataFrame, dx: float = 0.0, dy: float = 0.0, angle: float = 0.0, scale_x: float = 1.0, scale_y: float = 1.0, mirror: str = "NONE", anchor: str | tuple[float, float] = "CENTROID"
) -> DataFrame:
    """Paths scaled, mirrored across an axis and rotated counter-clockwise about the anchor (the centre of the layer's extent,
    ORIGIN, or a point), then shifted; other fields of a vertex are kept."""
    if anchor == "ORIGIN":
        ax, ay = 0.0, 0.0
    elif anchor == "CENTROID":
        ends = [outer(inner(F.col(f"path.{c}"))) for c in "xy" for outer, inner in ((F.min, F.array_min), (F.max, F.array_max))]
        x0, x1, y0, y1 = df.agg(*ends).first()
        if x0 is None:
            return df
        ax, ay = (x0 + x1) / 2, (y0 + y1) / 2
    else:
        ax, ay = anchor
    px, py = scale_x * (-1 if mirror == "Y" else 1), scale_y * (-1 if mirror == "X" else 1)
    cos, sin = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    a, b, c, d = cos * px, -sin * py, sin * px, cos * py
    e, f = ax - (a * ax + b * ay) + dx, ay - (c * ax + d * ay) + dy

    def moved(p: Column) -> Column:
        return p.withField("x", a * p["x"] + b * p["y"] + e).withField("y", c * p["x"] + d * p["y"] + f)

    return df.withColumn("path", F.transform("path", moved))


def flip_line(df: DataFrame) -> DataFrame:
    """Paths with their vertices in reverse order."""
    return df.withColumn("path", F.reverse("path"))


def _middle(path: Column) -> Column:
    """The point half-way along a path."""
    n = F.size(path) - 1
    legs = F.transform(
        F.arrays_zip(F.slice(path, 1, n).alias("a"), F.slice(path, 2, n).alias("b")),
        lambda s: F.struct(s["a"]["x"].alias("x"), s["a"]["y"].alias("y"), (s["b"]["x"] - s["a"]["x"]).alias("dx"), (s["b"]["y"] - s["a"]["y"]).alias("dy")),
    )
    length = lambda s: F.sqrt(s["dx"] * s["dx"] + s["dy"] * s["dy"])
    half = F.aggregate(legs, F.lit(0.0), lambda t, s: t + length(s)) / 2

    def walk(at: Column, s: Column) -> Column:
        here = ~at["done"] & (at["left"] <= length(s))
        share = F.coalesce(F.try_divide(at["left"], length(s)), F.lit(0.0))
        return F.struct(
            F.when(at["done"] | here, at["left"]).otherwise(at["left"] - length(s)).alias("left"), (at["done"] | here).alias("done"),
            F.when(here, s["x"] + s["dx"] * share).otherwise(at["x"]).alias("x"), F.when(here, s["y"] + s["dy"] * share).otherwise(at["y"]).alias("y"),
        )

    start = F.struct(half.alias("left"), F.lit(False).alias("done"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(legs, start, walk, lambda at: F.struct(at["x"].alias("x"), at["y"].alias("y")))


def feature_vertices_to_points(df: DataFrame, location: str = "ALL") -> DataFrame:
    """A row per chosen vertex with its x and y: all, the start, the end, both ends, the middle by length, or the ends
    that no other line end shares."""
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    if location == "MID":
        return df.withColumn("_p", _middle(F.col("path"))).select("*", "_p.x", "_p.y").drop("_p", "path")
    chosen = {"ALL": F.col("path"), "START": F.array(first), "END": F.array(last), "BOTH_ENDS": F.array(first, last), "DANGLE": F.array(first, last)}
    if location not in chosen:
        raise ValueError(f"location must be one of {', '.join([*chosen, 'MID'])}")
    out = df.where(F.size("path") > 0).select("*", F.explode(chosen[location]).alias("_p")).select("*", "_p.x", "_p.y").drop("_p", "path")
    if location == "DANGLE":
        lone = out.groupBy("x", "y").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
        out = out.join(lone, ["x", "y"], "left_semi")
    return out


def adjust_3d_z(df: DataFrame, factor: float = 1.0, offset: float = 0.0, from_unit: str = "meters", to_unit: str = "meters") -> DataFrame:
    """Paths with z converted between units, multiplied and then shifted; missing z stay missing."""
    scale = METRES[from_unit] / METRES[to_unit] * factor
    return df.withColumn("path", F.transform("path", lambda p: p.withField("z", p["z"] * scale + offset)))


def table_to_geometry(df: DataFrame, mode: str = "xy_to_line", **columns: str) -> DataFrame:
    """Planar two-point paths from start and end columns (start_x, start_y, end_x, end_y), or from a start (x, y), a compass
    bearing in degrees and a distance; rows that lack one have no path."""

    def of(name: str) -> Column:
        return F.col(columns.get(name, name)).cast("double")

    if mode == "xy_to_line":
        ends = [(of("start_x"), of("start_y")), (of("end_x"), of("end_y"))]
    elif mode == "bearing_distance":
        angle = F.radians(of("bearing"))
        ends = [(of("x"), of("y")), (of("x") + of("distance") * F.sin(angle), of("y") + of("distance") * F.cos(angle))]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    known = ends[0][0].isNotNull() & ends[0][1].isNotNull() & ends[1][0].isNotNull() & ends[1][1].isNotNull()
    return df.withColumn("path", F.when(known, F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ends))))


def _wrapped(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def calculate_utm_zone(df: DataFrame, zone_field: str = "utm_zone", epsg_field: str = "utm_epsg") -> DataFrame:
    """Zone and EPSG code of the UTM projection at (lon, lat), with the wider zones of Norway and Svalbard."""
    lon, lat = _wrapped(F.col("lon")), F.col("lat")
    zone = F.least(F.greatest(F.floor((lon + 180.0) / 6.0) + 1, F.lit(1)), F.lit(60))

    def within(c: Column, low: float, high: float) -> Column:
        return (c >= low) & (c < high)

    zone = F.when(within(lat, 56, 64) & within(lon, 3, 12), 32).otherwise(zone)
    svalbard = F.when(within(lon, 0, 9), 31).when(within(lon, 9, 21), 33).when(within(lon, 21, 33), 35).when(within(lon, 33, 42), 37).otherwise(zone)
    zone = F.when(within(lat, 72, 84), svalbard).otherwise(zone).cast("long")
    known = F.col("lon").isNotNull() & lat.isNotNull()
    return df.withColumn(zone_field, F.when(known, zone)).withColumn(epsg_field, F.when(known, F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("long"))


def calculate_grid_convergence_angle(df: DataFrame, angle_field: str = "convergence", angle_type: str = "geographic", central_meridian: float | None = None) -> DataFrame:
    """The angle from true to grid north at (lon, lat), in degrees clockwise, or with ``arithmetic`` counter-clockwise from
    east; the meridian defaults to that of the UTM zone."""
    lon = F.col("lon")
    middle = F.floor((_wrapped(lon) + 180.0) / 6.0) * 6.0 + 3.0 - 180.0 if central_meridian is None else F.lit(float(central_meridian))
    angle = F.degrees(F.atan(F.tan(F.radians(lon - middle)) * F.sin(F.radians("lat"))))
    return df.withColumn(angle_field, 90.0 - angle if angle_type == "arithmetic" else angle)


def calculate_central_meridian_and_parallels(df: DataFrame, field: str = "central_meridian", offset: float = 0.25) -> DataFrame:
    """The middle longitude of a path's extent, unwrapped at the antimeridian where that narrows it, and the standard parallels
    at ``offset`` of its height from the bottom and the top."""
    lons, lats = F.col("path.x"), F.col("path.y")
    turned = F.transform(lons, lambda x: F.when(x < 0, x + 360.0).otherwise(x))
    lo, hi, lo2, hi2 = F.array_min(lons), F.array_max(lons), F.array_min(turned), F.array_max(turned)
    over = (hi - lo > 180.0) & (hi - lo < 360.0) & (hi2 - lo2 < hi - lo)
    south, north = F.array_min(lats), F.array_max(lats)
    middle = _wrapped(F.when(over, (lo2 + hi2) / 2).otherwise((lo + hi) / 2))
    return df.withColumns({field: middle, "standard_parallel_1": south + (north - south) * offset, "standard_parallel_2": north - (north - south) * offset})


def convert_coordinate_notation(df: DataFrame, notation: str = "DMS", output: str = "coordinate") -> DataFrame:
    """(lon, lat) as text in decimal degrees (DD), degrees and minutes (DDM) or degrees, minutes and seconds (DMS)."""
    if notation == "DD":
        return df.withColumn(output, F.format_string("%.8f, %.8f", F.col("lat").cast("double"), F.col("lon").cast("double")))
    if notation not in ("DDM", "DMS"):
        raise ValueError("notation must be DD, DDM or DMS")

    def axis(v: Column, width: int, positive: str, negative: str) -> Column:
        whole = F.floor(F.abs(v))
        minutes, side = (F.abs(v) - whole) * 60.0, F.when(v >= 0, positive).otherwise(negative)
        if notation == "DDM":
            full = F.round(minutes, 3) >= 60.0
            return F.format_string(f"%0{width}d°%06.3f'%s", whole + full.cast("long"), F.when(full, 0.0).otherwise(minutes), side)
        seconds, minute = (minutes - F.floor(minutes)) * 60.0, F.floor(minutes)
        full = F.round(seconds, 3) >= 60.0
        minute, seconds = minute + full.cast("long"), F.when(full, 0.0).otherwise(seconds)
        over = minute >= 60
        return F.format_string(f"%0{width}d°%02d'%06.3f\"%s", whole + over.cast("long"), F.when(over, 0).otherwise(minute), seconds, side)

    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    return df.withColumn(output, F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws(" ", axis(lat, 2, "N", "S"), axis(lon, 3, "E", "W"))))


def assign_projection(df: DataFrame, epsg: int) -> DataFrame:
    """The rows of a vector layer, raster or point cloud tagged with a reference system; no coordinate changes."""
    if epsg <= 0:
        raise ValueError("an EPSG code is positive")
    return df.withColumn("crs_epsg", F.lit(epsg).cast("long"))


#: Fixed value: the greatest latitude of web tiles.
TILE_LATITUDE = 85.0511287798066


def tile_grid_polygons(extent: DataFrame, zoom: int, max_zoom: int | None = None, scheme: str = "xyz", max_tiles: int = 1_000_000) -> DataFrame:
    """The web tiles that cover the extent of points (lon, lat): z, x, y, quadkey, tile_id and corners in degrees. More than
    ``max_tiles`` is an error."""
    ends = extent.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    spark, rows = extent.sparkSession, []
    if ends[0] is None:
        raise ValueError("the extent is empty")

    def across(lon: float, z: int) -> int:
        return min(max(math.floor((lon + 180) / 360 * 2**z), 0), 2**z - 1)

    def down(lat: float, z: int) -> int:
        phi = math.radians(min(max(lat, -TILE_LATITUDE), TILE_LATITUDE))
        return min(max(math.floor((1 - math.asinh(math.tan(phi)) / math.pi) / 2 * 2**z), 0), 2**z - 1)

    for z in range(zoom, (zoom if max_zoom is None else max_zoom) + 1):
        rows.append((z, across(ends[0], z), across(ends[1], z), down(ends[3], z), down(ends[2], z)))
    if sum((r[2] - r[1] + 1) * (r[4] - r[3] + 1) for r in rows) > max_tiles:
        raise ValueError(f"more than {max_tiles} tiles")
    tiles = spark.createDataFrame(rows, "z int, x0 long, x1 long, y0 long, y1 long").select("z", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("z", "x", F.explode(F.sequence("y0", "y1")).alias("y"))
    n = F.pow(F.lit(2.0), F.col("z"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.when(i <= F.col("z"), _digit(F.col("z") - i)).otherwise(""))
    lat = lambda y: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * y / n))))
    label = (n - 1 - F.col("y")).cast("long") if scheme == "tms" else F.col("y")
    return tiles.select(
        F.col("z").cast("long").alias("z"), "x", label.alias("y"), F.concat_ws("", digits).alias("quadkey"), F.concat_ws("/", "z", "x", label).alias("tile_id"),
        (F.col("x") / n * 360.0 - 180.0).alias("west"), lat(F.col("y") + 1).alias("south"), ((F.col("x") + 1) / n * 360.0 - 180.0).alias("east"), lat(F.col("y")).alias("north"),
    )


def _digit(bit: Column) -> Column:
    """The quadkey digit of a tile at a bit of its numbers."""
    at = F.pow(F.lit(2.0), bit)
    return ((F.floor(F.col("x") / at) % 2) + 2 * (F.floor(F.col("y") / at) % 2)).cast("string")
