"""Points against polygons and bins, and the centres and spreads of groups of points.

A polygon is a row with ``ring``, its unclosed outer ring as an array of (x, y). Polygons are sent to the grid cells that their
boxes touch, of the mean size of these boxes, and meet the points of a cell there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbors import calculate_distance_band
from .table import finite


def _inside(x: Column, y: Column, edges: Column) -> Column:
    """Whether a ray from the point crosses an odd number of edges."""

    def crossed(e: Column) -> Column:
        at = e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * F.try_divide(y - e["a"]["y"], e["b"]["y"] - e["a"]["y"])
        return ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.size(F.filter(edges, crossed)) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, zone: str) -> DataFrame:
    """The points (fid, x, y, ...) with the zone of every polygon (zone, ring) that holds them."""
    ring = F.col("ring")
    box = {f"_{c}{k}": f(F.col(f"ring.{c}")) for c in "xy" for k, f in (("0", F.array_min), ("1", F.array_max))}
    edges = F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("b"))
    boxed = polygons.where(F.size("ring") > 2).select(zone, edges.alias("_edges"), *(c.alias(n) for n, c in box.items()))
    size = boxed.agg(F.avg(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")))).first()[0] or 1.0

    def cells(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))

    sent = boxed.withColumn("_cx", cells("_x0", "_x1")).withColumn("_cy", cells("_y0", "_y1"))
    placed = points.withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size))
    met = placed.join(sent, ["_cx", "_cy"]).where(F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1")))
    return met.where(_inside(F.col("x"), F.col("y"), F.col("_edges"))).drop("_cx", "_cy", "_edges", *box)


def summarize_within(polygons: DataFrame, points: DataFrame, zone: str, statistics: list[tuple[str, str]] = (), group: str | None = None, keep_all: bool = True) -> DataFrame:
    """Per zone (and group) the count of points inside and ``<statistic>_<field>`` columns over finite values, 0 without any;
    with ``keep_all`` empty zones have a row."""
    made = []
    for field, stat in statistics:
        x = finite(field)
        c = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "count": F.count}[stat](x)
        made.append(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"{stat}_{field}"))
    keys = [zone] + ([F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group")] if group else [])
    found = points_in_polygons(points, polygons, zone).groupBy(*keys).agg(F.count("*").alias("count"), *made)
    if not keep_all:
        return found
    every = polygons.select(zone).join(found, zone, "left").fillna({"count": 0} | {f"{s}_{f}": 0.0 for f, s in statistics})
    return every.fillna({"group": ""}) if group else every


def summarize_percent_change(polygons: DataFrame, current: DataFrame, previous: DataFrame, zone: str) -> DataFrame:
    """Per zone the points now and before, their difference, its per cent of those before, and the class of the change."""
    counts = [points_in_polygons(p, polygons, zone).groupBy(zone).agg(F.count("*").alias(n)) for p, n in ((current, "CURRENT_COUNT"), (previous, "PREVIOUS_COUNT"))]
    both = polygons.select(zone).join(counts[0], zone, "left").join(counts[1], zone, "left").fillna(0, ["CURRENT_COUNT", "PREVIOUS_COUNT"])
    now, before = F.col("CURRENT_COUNT"), F.col("PREVIOUS_COUNT")
    kind = (
        F.when((before == 0) & (now > 0), "new").when((now == 0) & (before > 0), "eliminated")
        .when(now > before, "increase").when(now < before, "decrease").otherwise("no_change")
    )
    return both.select(zone, now, before, (now - before).alias("COUNT_DIFF"), (100.0 * F.try_divide(now - before, before)).alias("PERCENT_CHANGE"), kind.alias("CHANGE_CLASS"))


def reduce_point_density(points: DataFrame, bin_size: float, sort: str | None = None, descending: bool = True, keep: str | None = None) -> DataFrame:
    """Points (fid, x, y, ...) with ``kept``: pinned ones, and of each bin without such the first by ``sort`` (missing as 0) and then fid."""
    pinned = F.coalesce(F.col(keep).cast("boolean"), F.lit(False)) if keep else F.lit(False)
    value = F.coalesce(finite(sort), F.lit(0.0)) if sort else F.lit(0.0)
    rows = points.where(finite("x").isNotNull() & finite("y").isNotNull()).withColumn("_pinned", pinned)
    order = [F.col("_pinned").desc(), value.desc() if descending else value.asc(), F.col("fid")]
    w = Window.partitionBy(F.floor(F.col("x") / bin_size), F.floor(F.col("y") / bin_size)).orderBy(*order)
    return rows.withColumn("kept", F.col("_pinned") | (F.row_number().over(w) == 1)).drop("_pinned")


def evaluate_bin_sizes(points: DataFrame, sizes: list[float] | None = None, shape: str = "hexagon", steps: int = 8, weight: str | None = None) -> DataFrame:
    """Per candidate size the bins that tile the extent, those with points and their share, and mean, upper median, greatest and
    coefficient of variation of what they hold. Sizes default to a geometric sweep from half the mean distance of nearest points."""
    placed = points.where(finite("x").isNotNull() & finite("y").isNotNull())
    box = placed.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if sizes is None:
        base = calculate_distance_band(placed).agg(F.avg("kth_neighbor_distance")).first()[0] or 1.0
        sizes = [base * 0.5 * 2 ** (i * 0.5) for i in range(steps)]
    if any(s <= 0 for s in sizes):
        raise ValueError("sizes must be positive")
    #: Fixed value: the height of a row of hexagons of width 1.
    high = 0.8660254037844386 if shape == "hexagon" else 1.0
    size, x, y = F.col("size"), F.col("x") - F.lit(box["x0"]), F.col("y") - F.lit(box["y0"])
    rows = placed.select("x", "y", (F.lit(1.0) if weight is None else finite(weight)).alias("_v"), F.explode(F.array(*(F.lit(float(s)) for s in sizes))).alias("size"))
    rows = rows.withColumn("_r", F.floor(y / (size * high)))
    shift = F.when((F.col("_r") % 2 == 1) & F.lit(shape == "hexagon"), size / 2).otherwise(0.0)
    bins = rows.groupBy("size", F.floor((x - shift) / size).alias("_c"), "_r").agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_v"))
    wide, tall = max((box["x1"] or 0.0) - (box["x0"] or 0.0), 2.0**-52), max((box["y1"] or 0.0) - (box["y0"] or 0.0), 2.0**-52)
    made = bins.groupBy("size").agg(
        F.count("*").alias("nonempty_bins"), F.avg("_v").alias("mean_per_bin"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _v DESC)").alias("median_per_bin"),
        F.max("_v").alias("max_per_bin"), F.coalesce(F.try_divide(F.stddev_pop("_v"), F.avg("_v")), F.lit(0.0)).alias("cv"),
    )
    total = ((F.floor(F.lit(wide) / size) + 1) * (F.floor(F.lit(tall) / (size * high)) + 1)).cast("long")
    return made.withColumn("bin_count", total).withColumn("nonempty_ratio", F.col("nonempty_bins") / F.col("bin_count"))


def directional_distribution(points: DataFrame, statistic: str, weight: str | None = None, case: str | None = None, n_std: float = 1.0) -> DataFrame:
    """Per case the weighted mean centre, the standard distance with its radius, or the standard deviational ellipse: rotation
    in degrees counter-clockwise from east, and half axes. Moments are summed about the centre of all, for precision."""
    placed = points.where(finite("x").isNotNull() & finite("y").isNotNull())
    c = placed.agg(F.avg("x"), F.avg("y")).first()
    dx, dy = F.col("x") - (c[0] or 0.0), F.col("y") - (c[1] or 0.0)
    w = F.lit(1.0) if weight is None else F.coalesce(finite(weight), F.lit(1.0))
    sums = {"w": w, "x": w * dx, "y": w * dy, "xx": w * dx * dx, "yy": w * dy * dy, "xy": w * dx * dy}
    found = placed.groupBy(F.lit("ALL").alias("group") if case is None else F.col(case).cast("string").alias("group")).agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items())).where("_w > 0")
    mx, my = F.col("_x") / F.col("_w"), F.col("_y") / F.col("_w")
    found = found.withColumn("_sxx", F.col("_xx") / F.col("_w") - mx * mx).withColumn("_syy", F.col("_yy") / F.col("_w") - my * my).withColumn("_sxy", F.col("_xy") / F.col("_w") - mx * my)
    x, y = mx + (c[0] or 0.0), my + (c[1] or 0.0)
    if statistic == "mean_center":
        return found.select("group", x.alias("x"), y.alias("y"))
    if statistic == "standard_distance":
        sd = F.sqrt(F.greatest(F.col("_sxx") + F.col("_syy"), F.lit(0.0)))
        return found.select("group", x.alias("center_x"), y.alias("center_y"), sd.alias("std_dist"), F.lit(float(n_std)).alias("n_std"), (sd * n_std).alias("radius"))
    if statistic != "standard_deviational_ellipse":
        raise ValueError(f"unknown statistic {statistic!r}")
    half = (F.col("_sxx") + F.col("_syy")) / 2
    apart = F.sqrt(F.greatest(half * half - (F.col("_sxx") * F.col("_syy") - F.col("_sxy") * F.col("_sxy")), F.lit(0.0)))
    found = found.withColumn("_l1", half + apart).withColumn("_l2", F.greatest(half - apart, F.lit(0.0))).where("_l1 > 0")
    angle = F.when(F.abs("_sxy") > 1e-12, F.atan2(F.col("_l1") - F.col("_sxx"), F.col("_sxy"))).when(F.col("_sxx") >= F.col("_syy"), 0.0).otherwise(F.pi() / 2)
    return found.select("group", x.alias("center_x"), y.alias("center_y"), F.degrees(angle).alias("rotation"), (F.sqrt("_l1") * n_std).alias("semi_major"), (F.sqrt("_l2") * n_std).alias("semi_minor"), F.lit(float(n_std)).alias("n_std"))


def linear_directional_mean(lines: DataFrame, case: str | None = None, orientation_only: bool = False, keep_points: bool = False) -> DataFrame:
    """Per case of lines (x0, y0, x1, y1) the mean compass bearing, circular variance, mean length and number; with
    ``orientation_only`` opposite directions count as one. Lines without length are passed over, or with ``keep_points`` point east."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fold = 2.0 if orientation_only else 1.0
    rows = lines.withColumn("_len", F.sqrt(dx * dx + dy * dy)).where("_len >= 0" if keep_points else "_len > 0").withColumn("_a", F.atan2(dy, dx) * fold)
    found = rows.groupBy(F.lit("ALL").alias("case") if case is None else F.col(case).cast("string").alias("case")).agg(
        F.sum(F.sin("_a")).alias("_s"), F.sum(F.cos("_a")).alias("_c"), F.avg("_len").alias("mean_len"), F.count("*").alias("n")
    )
    bearing = F.pmod(90.0 - F.degrees(F.atan2("_s", "_c") / fold), F.lit(360.0))
    return found.select("case", bearing.alias("mean_dir"), (1.0 - F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c")) / F.col("n")).alias("circ_var"), "mean_len", "n")


def classification_accuracy_assessment(points: DataFrame, reference: str, classified: str) -> DataFrame:
    """Points with REF_CLASS, MAP_CLASS (where both are known) and CORRECT; classes are rounded half away from zero."""
    truth, found = F.round(finite(reference)).cast("long"), F.round(finite(classified)).cast("long")
    out = points.withColumn("REF_CLASS", truth).withColumn("MAP_CLASS", F.when(truth.isNotNull(), found))
    return out.withColumn("CORRECT", F.coalesce(F.col("REF_CLASS") == F.col("MAP_CLASS"), F.lit(False)).cast("long"))


def accuracy_report(assessed: DataFrame) -> DataFrame:
    """Per class of an assessment its producer's and user's accuracy (0 without points), with overall accuracy and kappa."""
    pairs = assessed.where("REF_CLASS IS NOT NULL AND MAP_CLASS IS NOT NULL")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("REF_CLASS").alias("class"), F.lit(1).alias("r")), F.struct(F.col("MAP_CLASS").alias("class"), F.lit(0).alias("r")))).alias("e"), "CORRECT")
    rows = ends.groupBy(F.col("e.class").alias("class")).agg(F.sum("e.r").alias("_r"), F.sum(1 - F.col("e.r")).alias("_m"), F.sum(F.col("CORRECT") * F.col("e.r")).alias("_d"))
    whole = rows.agg(F.sum("_r").alias("n"), F.sum("_d").alias("d"), F.sum(F.col("_r").cast("double") * F.col("_m")).alias("e")).first()
    n = whole["n"] or 1
    overall, chance = (whole["d"] or 0) / n, (whole["e"] or 0.0) / n / n
    kappa = (overall - chance) / (1 - chance) if abs(1 - chance) > 2.0**-52 else 0.0
    share = [F.coalesce(F.try_divide("_d", c), F.lit(0.0)).alias(name) for c, name in (("_r", "producers_accuracy"), ("_m", "users_accuracy"))]
    return rows.select("class", *share, F.lit(overall).alias("overall_accuracy"), F.lit(kappa).alias("kappa"))
