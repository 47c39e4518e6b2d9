"""Raster operators on cells: one row per cell and layer (row, col, layer, v), null v for no data.

Per-cell operators group by (row, col), zonal ones by zone, block and focal ones by cells derived from
row and col; nothing needs a whole raster in one task. Two-pass scalings fit all layers in one aggregate
whose single row joins by broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["row", "col"]
STATISTICS = ("mean", "majority", "maximum", "median", "minimum", "minority", "percentile", "range", "std", "sum", "variety")


def _by_count(values: Column, sign: int) -> Column:
    """The value of the most (-1) or least (1) occurrences, the smallest of several."""
    counted = F.transform(
        F.array_distinct(values),
        lambda x: F.struct((sign * F.size(F.filter(values, lambda y: y == x))).alias("n"), x.alias("v")),
    )
    return F.array_min(counted)["v"]


def reducer(v: Column | str, statistic: str, percentile: float = 90.0) -> Column:
    """The statistic of a group's valid values; standard deviations are of the population."""
    v = F.col(v) if isinstance(v, str) else v
    made = {
        "mean": lambda: F.avg(v), "maximum": lambda: F.max(v), "minimum": lambda: F.min(v), "sum": lambda: F.sum(v),
        "median": lambda: F.percentile(v, F.lit(0.5)), "percentile": lambda: F.percentile(v, F.lit(percentile / 100)),
        "range": lambda: F.max(v) - F.min(v), "std": lambda: F.stddev_pop(v), "variety": lambda: F.count_distinct(v).cast("double"),
        "majority": lambda: _by_count(F.collect_list(v), -1), "minority": lambda: _by_count(F.collect_list(v), 1),
    }
    if statistic not in made:
        raise ValueError(f"statistic must be one of {', '.join(STATISTICS)}")
    return made[statistic]()


def _complete(out: DataFrame, ignore_nodata: bool) -> DataFrame:
    return out if ignore_nodata else out.withColumn("v", F.when(F.col("_n") == F.col("_valid"), F.col("v")))


def cell_statistics(cells: DataFrame, statistic: str = "mean", percentile: float = 90.0, ignore_nodata: bool = True) -> DataFrame:
    """One value per cell over the layers; unless no data is ignored, a layer without a value gives none."""
    out = cells.groupBy(*CELL).agg(reducer("v", statistic, percentile).alias("v"), F.count("*").alias("_n"), F.count("v").alias("_valid"))
    return _complete(out, ignore_nodata).select(*CELL, "v")


def cell_position_statistics(cells: DataFrame, statistic: str = "highest_position", selector: float | None = None) -> DataFrame:
    """The 1-based layer order of the extreme value (the first of several), the one value that occurs
    ``selector`` times, or the ``selector``-th smallest value."""
    values = F.collect_list("v")
    if statistic in ("highest_position", "lowest_position"):
        placed = cells.withColumn("_at", F.dense_rank().over(Window.partitionBy(*CELL).orderBy("layer")))
        extreme = F.max_by if statistic == "highest_position" else F.min_by
        first = -F.col("_at") if statistic == "highest_position" else F.col("_at")
        return placed.groupBy(*CELL).agg(extreme("_at", F.when(F.col("v").isNotNull(), F.struct("v", first))).cast("double").alias("v"))
    if selector is None:
        raise ValueError(f"{statistic} needs a selector")
    if statistic == "popularity":
        hits = F.filter(F.array_distinct(values), lambda x: F.size(F.filter(values, lambda y: y == x)) == F.lit(selector))
        return cells.groupBy(*CELL).agg(F.when(F.size(hits) == 1, hits[0]).alias("v"))
    if statistic == "rank":
        n = int(selector) if selector >= 1 and float(selector).is_integer() else None
        found = F.get(F.array_sort(values), F.lit(n - 1)) if n else F.lit(None).cast("double")
        return cells.groupBy(*CELL).agg(found.alias("v"))
    raise ValueError(f"unknown statistic {statistic!r}")


def _compare(v: Column, to: Column, comparison: str, tolerance: float = 0.0) -> Column:
    return {
        "equal": F.abs(v - to) <= tolerance, "not_equal": F.abs(v - to) > tolerance, "greater": v > to, ">": v > to,
        "greater_equal": v >= to, ">=": v >= to, "less": v < to, "<": v < to, "less_equal": v <= to, "<=": v <= to,
    }[comparison]


def find_argument_statistics(cells: DataFrame, statistic: str = "argmax", threshold: float | None = None, comparison: str = ">", min_valid: int = 1) -> DataFrame:
    """The 0-based slice of the extreme or middle value (the first of several), how many slices meet the
    threshold, or the longest run of such slices; no data is passed over."""
    order = Window.partitionBy(*CELL).orderBy("layer")
    placed = cells.withColumn("_at", F.dense_rank().over(order) - 1).where("v IS NOT NULL")
    enough = F.count("*") >= min_valid
    if statistic in ("argmax", "argmin"):
        out = F.max_by("_at", F.struct("v", -F.col("_at"))) if statistic == "argmax" else F.min_by("_at", F.struct("v", "_at"))
    elif statistic == "median_position":
        out = F.array_sort(F.collect_list(F.struct("v", "_at")))[((F.count("*") - 1) / 2).cast("int")]["_at"]
    elif statistic in ("duration", "longest_run"):
        if threshold is None:
            raise ValueError(f"{statistic} needs a threshold")
        hit = _compare(F.col("v"), F.lit(threshold), comparison)
        if statistic == "duration":
            out = F.count_if(hit)
        else:
            # Consecutive slices that meet it have the same difference of slice and count so far.
            placed = placed.withColumn("_hit", hit).withColumn("_run", F.col("_at") - F.sum(F.col("_hit").cast("int")).over(order))
            runs = placed.groupBy(*CELL, "_run").agg(F.count_if("_hit").alias("n"), F.count("*").alias("m"))
            return runs.groupBy(*CELL).agg(F.when(F.sum("m") >= min_valid, F.max("n")).cast("double").alias("v"))
    else:
        raise ValueError(f"unknown statistic {statistic!r}")
    return placed.groupBy(*CELL).agg(F.when(enough, out).cast("double").alias("v"))


def frequency_comparison(reference: DataFrame, cells: DataFrame, comparison: str = "equal", tolerance: float = 0.0) -> DataFrame:
    """How many layers compare so with the reference raster (row, col, v), per cell."""
    base = reference.select(*CELL, F.col("v").alias("_ref"))
    return base.join(cells, CELL).groupBy(*CELL).agg(F.count_if(_compare(F.col("v"), F.col("_ref"), comparison, tolerance)).alias("v"))


def wide(cells: DataFrame, layers: list) -> DataFrame:
    """One column per layer, b0, b1 and so on."""
    return cells.groupBy(*CELL).agg(*(F.max(F.when(F.col("layer") == x, F.col("v"))).alias(f"b{k}") for k, x in enumerate(layers)))


def composite_bands(rasters: list[DataFrame], policy: str = "any") -> DataFrame:
    """Rasters (row, col, v) stacked as layers 1, 2, …; with ``any`` a cell without data in one has none in all."""
    made = reduce(DataFrame.unionByName, [r.select(*CELL, F.lit(k + 1).alias("layer"), "v") for k, r in enumerate(rasters)])
    if policy == "all":
        return made
    short = F.count("v").over(Window.partitionBy(*CELL)) < len(rasters)
    return made.withColumn("v", F.when(~short, F.col("v")))


def band_collection_statistics(cells: DataFrame, layers: list) -> tuple[DataFrame, DataFrame]:
    """Per layer its statistics over its own valid cells; per pair of layers their population covariance and
    correlation over the cells that are valid in all."""
    own = cells.where("v IS NOT NULL").groupBy("layer").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    bands = wide(cells, layers).dropna()
    pairs = [(a, b) for a in range(len(layers)) for b in range(len(layers)) if a <= b]
    row = F.array(*(F.struct(F.lit(layers[a]).alias("a"), F.lit(layers[b]).alias("b"), F.col(f"cov{a}_{b}").alias("covariance"), F.col(f"cor{a}_{b}").alias("correlation")) for a, b in pairs))
    sums = bands.agg(*(x for a, b in pairs for x in (F.covar_pop(f"b{a}", f"b{b}").alias(f"cov{a}_{b}"), F.corr(f"b{a}", f"b{b}").alias(f"cor{a}_{b}"))))
    return own, sums.select(F.explode(row).alias("p")).select("p.*")


def combine(cells: DataFrame, layers: list) -> tuple[DataFrame, DataFrame]:
    """An id from 1 per combination of the layers' values, in the order of the values, and its table; a
    cell without data in one layer has none."""
    bands = [f"b{k}" for k in range(len(layers))]
    valid = wide(cells, layers).dropna()
    table = valid.groupBy(*bands).agg(F.count("*").alias("count"))
    # One row per distinct combination, which is the attribute table.
    table = table.withColumn("id", F.row_number().over(Window.orderBy(*bands)).cast("long"))
    return valid.join(table, bands).select(*CELL, "id"), table


def _fitted(cells: DataFrame, *made: Column) -> DataFrame:
    """cells with the columns of one aggregate over them, by layer."""
    return cells.join(F.broadcast(cells.groupBy("layer").agg(*made)), "layer")


def raster_normalize(cells: DataFrame) -> DataFrame:
    """Each layer's values on 0 to 1; a layer of one value is 0."""
    out = _fitted(cells, F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    return out.select(*CELL, "layer", F.when(F.col("v").isNull(), None).when(spread == 0, 0.0).otherwise((F.col("v") - F.col("_lo")) / spread).alias("v"))


def spectral_index(bands: DataFrame, index: str, red="red", nir="nir", green="green", blue="blue", swir="swir", soil_factor: float = 0.5) -> DataFrame:
    """A normalised difference or vegetation index of band columns; a zero denominator gives no data."""
    r, n, g, b, s = (F.col(c) for c in (red, nir, green, blue, swir)) if index == "evi" else (F.col(red) if index in ("ndvi", "savi") else None, F.col(nir), F.col(green) if index == "ndwi" else None, None, F.col(swir) if index in ("ndbi", "nbr") else None)
    parts = {
        "ndvi": lambda: (n - r, n + r), "ndwi": lambda: (g - n, g + n), "ndbi": lambda: (s - n, s + n), "nbr": lambda: (n - s, n + s),
        "evi": lambda: (2.5 * (n - r), n + 6.0 * r - 7.5 * b + 1.0), "savi": lambda: ((1 + soil_factor) * (n - r), n + r + soil_factor),
    }
    top, bottom = parts[index]()
    return bands.select(*CELL, F.when(bottom != 0, top / bottom).alias("v"))


def multicriteria_overlay(cells: DataFrame, layers: list, method: str = "weighted_sum", weights: list[float] | None = None, order_weights: list[float] | None = None) -> DataFrame:
    """The layers' weighted sum, weighted geometric mean or ordered weighted average; weights are scaled to sum
    to 1, and cells need data in every layer."""
    n = len(layers)
    w = weights or [1.0] * n
    w = [x / sum(w) for x in w]
    bands = [F.col(f"b{k}") for k in range(n)]
    if method == "weighted_sum":
        v = reduce(lambda a, b: a + b, [b * x for b, x in zip(bands, w)])
    elif method == "weighted_geometric_mean":
        total = reduce(lambda a, b: a + b, [F.log(b) * x for b, x in zip(bands, w)])
        v = F.when(F.least(*bands) > 0, F.exp(total)).otherwise(0.0)
    elif method == "owa":
        o = order_weights or [1.0] * n
        ranked = F.sort_array(F.array(*[b * x * n for b, x in zip(bands, w)]), asc=False)
        v = reduce(lambda a, b: a + b, [ranked[k] * (x / sum(o)) for k, x in enumerate(o)])
    else:
        raise ValueError(f"unknown method {method!r}")
    return wide(cells, layers).dropna().select(*CELL, v.alias("v"))


def fuzzy_membership(cells: DataFrame, function: str = "linear", midpoint: float | None = None, spread: float | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Membership of each value, 0 to 1; the midpoint is the layer's mean and the bounds its extremes by default."""
    out = _fitted(cells, F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.avg("v").alias("_mean"))
    x, mid = F.col("v"), F.col("_mean") if midpoint is None else F.lit(midpoint)
    lo, hi = F.col("_lo") if low is None else F.lit(low), F.col("_hi") if high is None else F.lit(high)
    made = {
        "linear": F.when(hi == lo, F.when(x >= hi, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / (hi - lo)))),
        "gaussian": F.exp(-F.lit(0.1 if spread is None else spread) * (x - mid) * (x - mid)),
        "small": F.when(mid == 0, 0.0).otherwise(1.0 / (1.0 + F.pow(x / mid, F.lit(spread or 5.0)))),
        "large": F.when((mid == 0) | (x <= 0), 0.0).otherwise(1.0 / (1.0 + F.pow(x / mid, F.lit(-(spread or 5.0))))),
    }[function]
    return out.select(*CELL, "layer", F.when(x.isNotNull(), made).alias("v"))


def fuzzy_overlay(cells: DataFrame, overlay: str = "and", gamma: float = 0.9) -> DataFrame:
    """Memberships combined per cell: the least, the greatest, their product, their algebraic sum, or gamma."""
    values = F.collect_list("v")
    product = F.aggregate(values, F.lit(1.0), lambda a, x: a * x)
    either = 1.0 - F.aggregate(values, F.lit(1.0), lambda a, x: a * (1.0 - x))
    made = {"and": F.min("v"), "or": F.max("v"), "product": product, "sum": either, "gamma": F.pow(either, F.lit(gamma)) * F.pow(product, F.lit(1.0 - gamma))}
    return cells.groupBy(*CELL).agg(made[overlay].alias("v"))


def slice_raster(cells: DataFrame, zones: int, slice_type: str = "equal_interval", base: int = 1) -> DataFrame:
    """The zone of each value by equal intervals or equal areas: ``base`` plus the breaks below it."""
    if slice_type == "equal_interval":
        out = _fitted(cells, F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        cuts = F.array(*(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / zones for k in range(1, zones)))
    elif slice_type == "equal_area":
        out = _fitted(cells, F.percentile("v", F.array(*(F.lit(k / zones) for k in range(1, zones)))).alias("_cuts"))
        cuts = F.col("_cuts")
    else:
        raise ValueError(f"unknown slice type {slice_type!r}")
    zone = F.size(F.filter(cuts, lambda c: F.col("v") > c)) + base
    return out.select(*CELL, "layer", F.when(F.col("v").isNotNull(), zone).cast("long").alias("zone"))


def generate_trend_raster(cells: DataFrame, min_valid: int = 3) -> DataFrame:
    """Slope, intercept and r2 of v over the layers as times; null without spread in time or enough values."""
    valid = cells.where("v IS NOT NULL")
    t = F.col("layer").cast("double")
    fit = valid.groupBy(*CELL).agg(
        F.regr_slope("v", t).alias("slope"), F.regr_intercept("v", t).alias("intercept"),
        F.when(F.var_pop("v") == 0, 1.0).otherwise(F.regr_r2("v", t)).alias("r2"), F.count("*").alias("n"), F.count_distinct("layer").alias("_times"),
    )
    enough = (F.col("n") >= max(2, min_valid)) & (F.col("_times") > 1)
    return fit.select(*CELL, *(F.when(enough, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")), "n")


def predict_using_trend_raster(trend: DataFrame, times: list[float]) -> DataFrame:
    """The fitted value of every cell at each time, as layers."""
    at = F.explode(F.array(*(F.lit(float(t)) for t in times))).alias("layer")
    return trend.select(*CELL, "slope", "intercept", at).select(*CELL, "layer", (F.col("intercept") + F.col("slope") * F.col("layer")).alias("v"))


def multidimensional_anomaly(cells: DataFrame, method: str = "difference_from_mean", reference: tuple[float, float] | None = None) -> DataFrame:
    """Each slice against its cell's baseline over the reference slices (all by default)."""
    w = Window.partitionBy(*CELL)
    v = F.col("v") if reference is None else F.when(F.col("layer").between(*reference), F.col("v"))
    mean, x = F.avg(v).over(w), F.col("v")
    made = {
        "difference_from_mean": lambda: x - mean, "difference_from_median": lambda: x - F.percentile(v, F.lit(0.5)).over(w),
        "percent_of_mean": lambda: F.when(mean != 0, 100.0 * x / mean),
        "z_score": lambda: F.when(F.stddev_pop(v).over(w) == 0, 0.0).otherwise((x - mean) / F.stddev_pop(v).over(w)),
    }[method]()
    return cells.select(*CELL, "layer", F.when(x.isNotNull(), made).alias("v"))


def multidimensional_raster_correlation(first: DataFrame, second: DataFrame, lag: int = 0, min_valid: int = 3) -> DataFrame:
    """Pearson's r per cell over the slices that both cubes have; the second one's slices are shifted by ``lag``."""
    other = second.select(*CELL, (F.col("layer") - lag).alias("layer"), F.col("v").alias("_w"))
    both = first.join(other, [*CELL, "layer"]).where("v IS NOT NULL AND _w IS NOT NULL")
    return both.groupBy(*CELL).agg(F.when(F.count("*") >= min_valid, F.corr("v", "_w")).alias("r"), F.count("*").alias("n"))


def dimensional_moving_statistics(cells: DataFrame, statistic: str = "mean", backward: int = 1, forward: int = 1, percentile: float = 90.0) -> DataFrame:
    """A statistic of the slices around each, per cell."""
    w = Window.partitionBy(*CELL).orderBy("layer").rowsBetween(-backward, forward)
    values = F.collect_list("v").over(w)
    if statistic in ("majority", "minority"):
        made = _by_count(values, -1 if statistic == "majority" else 1)
    elif statistic in ("mean", "maximum", "minimum", "sum", "std"):
        made = {"mean": F.avg, "maximum": F.max, "minimum": F.min, "sum": F.sum, "std": F.stddev_pop}[statistic]("v").over(w)
    else:
        at = F.array_sort(values)
        p = (F.size(values) - 1) * (0.5 if statistic == "median" else percentile / 100)
        low, high = F.get(at, F.floor(p).cast("int")), F.get(at, F.ceil(p).cast("int"))
        made = low + (high - low) * (p - F.floor(p))
    return cells.select(*CELL, "layer", F.when(F.size(values) > 0, made).alias("v"))


def aggregate_multidimensional_raster(cells: DataFrame, method: str = "mean", interval: float | None = None, start: float = 0.0) -> DataFrame:
    """Slices binned by intervals of the dimension from ``start`` (all in one without), reduced per cell."""
    at = F.lit(0) if interval is None else F.floor((F.col("layer") - start) / interval)
    return cells.groupBy(*CELL, at.cast("long").alias("slice")).agg(reducer("v", method).alias("v"))


def merge_multidimensional_rasters(cubes: list[DataFrame], resolve: str = "first") -> DataFrame:
    """Cubes joined by slice; where several have a valid cell one value is made of theirs."""
    every = reduce(DataFrame.unionByName, [c.select(*CELL, "layer", "v", F.lit(k).alias("_k")) for k, c in enumerate(cubes)])
    valid = F.when(F.col("v").isNotNull(), F.col("_k"))
    made = {"first": F.min_by("v", valid), "last": F.max_by("v", valid), "mean": F.avg("v"), "min": F.min("v"), "max": F.max("v")}[resolve]
    return every.groupBy(*CELL, "layer").agg(made.alias("v"))


def subset_multidimensional_raster(cells: DataFrame, values: list | None = None, between: tuple | None = None, step: int = 1) -> DataFrame:
    """Slices by value or range, every ``step``-th of them."""
    out = cells if values is None else cells.where(F.col("layer").isin(values))
    out = out if between is None else out.where(F.col("layer").between(*between))
    if step == 1:
        return out
    # One row per slice of the dimension.
    kept = out.select("layer").distinct().withColumn("_k", F.row_number().over(Window.orderBy("layer")) - 1).where(F.col("_k") % step == 0)
    return out.join(F.broadcast(kept.drop("_k")), "layer", "left_semi")


def summarize_categorical_raster(cells: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """Per layer and class its cells, their share in per cent and their area."""
    counts = cells.where("v IS NOT NULL").groupBy("layer", F.round("v").cast("long").alias("class")).agg(F.count("*").alias("cell_count"))
    share = 100.0 * F.col("cell_count") / F.sum("cell_count").over(Window.partitionBy("layer"))
    return counts.withColumn("percent", share).withColumn("area", F.col("cell_count") * cell_area)


def block_statistics(cells: DataFrame, statistic: str = "mean", height: int = 3, width: int = 3) -> DataFrame:
    """Every cell of a layer with the statistic of its rectangular block."""
    block = [F.floor(F.col("row") / height).alias("_r"), F.floor(F.col("col") / width).alias("_c")]
    found = cells.groupBy("layer", *block).agg(reducer("v", statistic).alias("v"))
    return cells.select(*CELL, "layer", *block).join(found, ["layer", "_r", "_c"]).select(*CELL, "layer", "v")


def focal_statistics(cells: DataFrame, statistic: str = "mean", height: int = 3, width: int = 3) -> DataFrame:
    """The statistic of the rectangle around every cell: each value is sent to the cells that it is near."""
    dr = F.explode(F.sequence(F.lit(-(height // 2)), F.lit((height - 1) // 2))).alias("_dr")
    dc = F.explode(F.sequence(F.lit(-(width // 2)), F.lit((width - 1) // 2))).alias("_dc")
    spread = cells.where("v IS NOT NULL").select("*", dr).select("*", dc)
    sent = spread.select("layer", (F.col("row") - F.col("_dr")).alias("row"), (F.col("col") - F.col("_dc")).alias("col"), "v")
    found = sent.groupBy("layer", *CELL).agg(reducer("v", statistic).alias("v"))
    return cells.select("layer", *CELL).join(found, ["layer", *CELL], "left").select(*CELL, "layer", "v")


def zonal_characterization(zones: DataFrame, cells: DataFrame, percentile: float = 90.0) -> DataFrame:
    """Per zone and layer all statistics in one pass; zones are (row, col, zone)."""
    names = ("mean", "minimum", "maximum", "range", "std", "sum", "median", "percentile", "variety")
    joined = zones.where("zone IS NOT NULL").join(cells, CELL)
    return joined.groupBy("zone", "layer").agg(F.count("v").alias("cell_count"), *(reducer("v", s, percentile).alias(s) for s in names))


def zonal_histogram(zones: DataFrame, values: DataFrame, mode: str = "classes", bins: int = 10) -> DataFrame:
    """zone, class and count of the cells valid in both; classes are rounded values or equal bins of their range, the
    last of which holds its upper end. Zero counts are left out."""
    both = zones.join(values, CELL).where("zone IS NOT NULL AND v IS NOT NULL")
    if mode == "classes":
        key = F.round("v").cast("long")
    else:
        both = both.join(F.broadcast(both.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))))
        spread = F.col("_hi") - F.col("_lo")
        key = F.when(spread == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("_lo")) / spread * bins))).cast("long")
    return both.groupBy(F.round("zone").cast("long").alias("zone"), key.alias("class")).agg(F.count("*").alias("count"))


def _edges(zones: DataFrame) -> DataFrame:
    """Per zoned cell, how many of its four sides face another zone, no data or the outside."""
    sides = F.array(*(F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    sent = zones.select((F.col("row")).alias("_r"), F.col("col").alias("_c"), "zone", F.explode(sides).alias("s"))
    sent = sent.select((F.col("_r") + F.col("s.r")).alias("row"), (F.col("_c") + F.col("s.c")).alias("col"), "zone")
    same = sent.groupBy(*CELL, "zone").agg(F.count("*").alias("_same"))
    return zones.join(same, [*CELL, "zone"], "left").withColumn("open", 4 - F.coalesce("_same", F.lit(0))).drop("_same")


def zonal_geometry(zones: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """Area, perimeter and centroid of every zone."""
    return _edges(zones.where("zone IS NOT NULL")).groupBy("zone").agg(
        (F.count("*") * cell_size * cell_size).alias("area"), (F.sum("open") * cell_size).alias("perimeter"),
        (F.avg(F.col("col") + 0.5) * cell_size).alias("centroid_x"), (F.avg(F.col("row") + 0.5) * cell_size).alias("centroid_y"),
    )


def zonal_fill(zones: DataFrame, weight: DataFrame) -> DataFrame:
    """Every cell of a zone with the least weight along the zone's boundary."""
    edge = _edges(zones.where("zone IS NOT NULL")).where("open > 0").join(weight, CELL)
    return zones.join(edge.groupBy("zone").agg(F.min("v").alias("v")), "zone").select(*CELL, "v")


def spatial_association_between_zones(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: homogeneity, completeness and their harmonic mean, the V-measure, of two zonings."""
    both = first.select(*CELL, F.col("zone").alias("a")).join(second.select(*CELL, F.col("zone").alias("b")), CELL).dropna()
    table = both.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    na, nb = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b"))
    sums = table.select("a", "b", "n", na.alias("na"), nb.alias("nb"))
    total = table.agg(F.sum("n").alias("t"))
    rows = sums.join(F.broadcast(total))
    made = rows.agg(
        F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias("hab"),
        F.sum(-F.col("n") / F.col("t") * F.log(F.col("na") / F.col("t"))).alias("ha"), F.sum(-F.col("n") / F.col("t") * F.log(F.col("nb") / F.col("t"))).alias("hb"),
    )
    # Of the second zoning given the first and the other way round.
    h = F.when(F.col("ha") == 0, 1.0).otherwise(1 - (F.col("hab") - F.col("hb")) / F.col("ha"))
    c = F.when(F.col("hb") == 0, 1.0).otherwise(1 - (F.col("hab") - F.col("ha")) / F.col("hb"))
    return made.select(h.alias("homogeneity"), c.alias("completeness")).withColumn("v_measure", F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness"))))
