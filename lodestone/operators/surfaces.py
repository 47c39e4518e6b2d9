"""Rescaling, radar, terrain and class operators on cells (row, col, layer, v) or, of one layer, (row, col, v).

Neighbours are gathered by sending each value to the cells around it and grouping by cell: one shuffle, no raster in one task."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import CELL, _by_count, reducer

#: The eight neighbours from east counter-clockwise; the k-th has bit k of the flow mask.
AROUND = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
#: Fixed value: the wavelength of C band in metres.
C_BAND = 0.05546576


def _gathered(cells: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """(row, col, n0, n1, ...): the value of every cell and of those at the given steps, null where there is none."""
    sent = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(k).alias("k")) for k, (r, c) in enumerate([(0, 0), *steps]))))
    rows = cells.select("row", "col", "v", sent.alias("s")).select((F.col("row") - F.col("s.r")).alias("row"), (F.col("col") - F.col("s.c")).alias("col"), "s.k", "v")
    made = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"n{k}") for k in range(len(steps) + 1)]
    return rows.groupBy(*CELL).agg(F.count_if(F.col("k") == 0).alias("_own"), *made).where("_own > 0").drop("_own")


def rescale_by_function(
    cells: DataFrame, function: str = "linear", from_scale: float = 0.0, to_scale: float = 1.0, param1: float | None = None, param2: float | None = None,
    low: float | None = None, high: float | None = None, below: float | None = None, above: float | None = None,
) -> DataFrame:
    """Values through a transfer function of their place in the range, clamped to 0 to 1 and spread over the scale; beyond the
    thresholds the given values, by default the ends of the scale."""
    f = cells.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if f["lo"] is None:
        raise ValueError("the raster has no values")
    lo, hi, v = float(f["lo"]), float(f["hi"]), F.col("v").cast("double")
    t = (v - lo) / (hi - lo) if hi > lo else F.lit(0.0)

    def logistic(k: float) -> Column:
        ends = [1 / (1 + math.exp(-k * (e - 0.5))) for e in (0, 1)]
        return t if abs(ends[1] - ends[0]) < 1e-12 else (1.0 / (1.0 + F.exp(-k * (t - 0.5))) - ends[0]) / (ends[1] - ends[0])

    def given(value: float | None, default: float) -> float:
        return default if value is None else value

    away = (v - given(param1, (lo + hi) / 2)) / max(abs(given(param2, (hi - lo) / 6)), 1e-9)
    k = given(param1, 5.0)
    shape = {
        "linear": lambda: t, "inverse_linear": lambda: 1.0 - t, "power": lambda: F.pow(t, F.lit(max(given(param1, 2.0), 1e-6))),
        "exponential": lambda: t if abs(k) < 1e-9 else (F.exp(k * t) - 1.0) / (math.exp(k) - 1.0),
        "logarithmic": lambda: F.log(1.0 + max(given(param1, 9.0), 1e-6) * t) / math.log(1 + max(given(param1, 9.0), 1e-6)),
        "logistic": lambda: logistic(given(param1, 10.0)), "large": lambda: logistic(given(param1, 10.0)), "small": lambda: 1.0 - logistic(given(param1, 10.0)),
        "gaussian": lambda: F.exp(-0.5 * away * away), "near": lambda: 1.0 / (1.0 + away * away), "symmetric_linear": lambda: 1.0 - F.abs(2.0 * t - 1.0),
    }
    if function not in shape:
        raise ValueError(f"function must be one of {', '.join(shape)}")
    out = from_scale + F.greatest(F.lit(0.0), F.least(F.lit(1.0), shape[function]())) * (to_scale - from_scale)
    if high is not None:
        out = F.when(v > high, given(above, to_scale)).otherwise(out)
    if low is not None:
        out = F.when(v < low, given(below, from_scale)).otherwise(out)
    return cells.withColumn("v", F.when(v.isNotNull(), out))


def convert_sar_units(cells: DataFrame, conversion: str, wavelength: float = C_BAND) -> DataFrame:
    """Values of one layer converted; those out of a function's domain become null. A complex raster has layers 0 and 1."""
    v = F.col("v").cast("double")
    if conversion == "complex_to_intensity":
        parts = cells.where(F.col("layer").isin(0, 1)).groupBy(*CELL)
        return parts.agg(F.when(F.count("v") == 2, F.sum(v * v)).alias("v"))
    made = {
        "linear_to_db": F.when(v > 0, 10.0 * F.log10(v)), "db_to_linear": F.pow(F.lit(10.0), v / 10.0), "amplitude_to_intensity": v * v,
        "intensity_to_amplitude": F.when(v >= 0, F.sqrt(v)), "phase_to_displacement": -v * wavelength / (4 * math.pi),
    }
    if conversion not in made:
        raise ValueError(f"conversion must be one of {', '.join([*made, 'complex_to_intensity'])}")
    return cells.withColumn("v", made[conversion])


def compute_sar_indices(cells: DataFrame, index: str, bands: dict[str, int], db: bool = False) -> DataFrame:
    """A radar index of the polarisations (hh, hv, vh, vv) that ``bands`` gives the layers of; null where one is missing or
    the denominator is 0. RVI takes hh, vv and hv where all three have values, else vv and vh."""
    v = F.pow(F.lit(10.0), F.col("v") / 10.0) if db else F.col("v").cast("double")
    wide = cells.groupBy(*CELL).agg(*(F.max(F.when(F.col("layer") == layer, v)).alias(p) for p, layer in bands.items()))

    def has(*names: str) -> bool:
        return all(n in bands for n in names)

    def ratio(above: Column, below: Column) -> Column:
        return F.when(F.abs(below) > 2.0**-52, F.try_divide(above, below))

    hh, hv, vh, vv = (F.col(p) if p in bands else F.lit(None).cast("double") for p in ("hh", "hv", "vh", "vv"))
    needs = {"rvi": [("hh", "vv", "hv"), ("vv", "vh")], "rfdi": [("hh", "hv")], "csi": [("vv", "hh")], "dpsvi": [("vv", "vh")]}
    if index not in needs or not any(has(*n) for n in needs[index]):
        raise ValueError(f"{index!r} is unknown or lacks a polarisation")
    quad = F.when(hh.isNotNull() & vv.isNotNull() & hv.isNotNull(), True)
    made = {
        "rvi": F.when(quad, ratio(8.0 * hv, hh + vv + 2.0 * hv)).otherwise(ratio(4.0 * vh, vv + vh)),
        "rfdi": ratio(hh - hv, hh + hv), "csi": ratio(vv, vv + hh), "dpsvi": ratio(vh * (vv + vh), vv),
    }
    return wide.select(*CELL, made[index].alias("v"))


def apply_radiometric_calibration(cells: DataFrame, kind: str = "sigma0", constant: float = 1.0, incidence: float | None = None, units: str = "dn", db: bool = False) -> DataFrame:
    """Backscatter beta0, sigma0 or gamma0 of raw values, by a calibration constant and an incidence angle in degrees within
    (0, 90); values out of domain become null."""
    v = F.col("v").cast("double")
    power = {"dn": v * v, "amplitude": v * v, "intensity": F.when(v >= 0, v), "db": F.pow(F.lit(10.0), v / 10.0)}[units]
    if kind != "beta0" and incidence is None:
        raise ValueError(f"{kind} needs an incidence angle")
    if constant <= 0 or (kind != "beta0" and not 0 < incidence < 90):
        return cells.withColumn("v", F.lit(None).cast("double"))
    factor = {"beta0": lambda: 1.0, "sigma0": lambda: math.sin(math.radians(incidence)), "gamma0": lambda: math.tan(math.radians(incidence))}[kind]()
    out = power / (constant * constant) * factor
    return cells.withColumn("v", F.when(out > 0, 10.0 * F.log10(out)) if db else out)


def multilook(cells: DataFrame, range_looks: int, azimuth_looks: int, amplitude: bool = False, units: str = "intensity", statistic: str = "mean") -> DataFrame:
    """Blocks of looks averaged as intensities; a block without values is null."""
    v = F.col("v").cast("double")
    made = reducer(v * v if amplitude else v, statistic)
    blocks = cells.groupBy(F.floor(F.col("row") / azimuth_looks).alias("row"), F.floor(F.col("col") / range_looks).alias("col")).agg(made.alias("v"))
    v = F.col("v")
    return blocks.withColumn("v", {"intensity": v, "amplitude": F.sqrt(F.greatest(v, F.lit(0.0))), "db": F.when(v > 0, 10.0 * F.log10(v))}[units] if units != "amplitude" else F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0)))))


def corridor(first: DataFrame, second: DataFrame, threshold: float | None = None, percent: float | None = None) -> DataFrame:
    """The sum of two accumulated-cost rasters where both have values, null above the threshold or above ``percent`` per cent
    more than the least sum."""
    both = first.select(*CELL, "v").join(second.select(*CELL, F.col("v").alias("_w")), CELL).withColumn("v", F.col("v") + F.col("_w")).drop("_w")
    if threshold is None and percent is not None:
        least = both.agg(F.min("v")).first()[0]
        threshold = None if least is None else least * (1 + percent / 100)
    return both if threshold is None else both.withColumn("v", F.when(F.col("v") <= threshold, F.col("v")))


def cut_fill(before: DataFrame, after: DataFrame | None = None, plane: float | None = None, tolerance: float = 0.0) -> DataFrame:
    """Per cell with both surfaces (or above a plane) the change dz and its class: fill, cut or unchanged within the tolerance."""
    if (after is None) == (plane is None):
        raise ValueError("give either a later surface or a plane")
    if after is None:
        both = before.select(*CELL, (F.col("v") - plane).alias("dz"))
    else:
        both = before.select(*CELL, F.col("v").alias("_b")).join(after.select(*CELL, F.col("v").alias("_a")), CELL).select(*CELL, (F.col("_a") - F.col("_b")).alias("dz"))
    kind = F.when(F.col("dz") > tolerance, "fill").when(F.col("dz") < -tolerance, "cut").otherwise("unchanged")
    return both.where("dz IS NOT NULL").withColumn("class", kind)


def cut_fill_volumes(changes: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """One row: volumes and cells of cut, fill and no change."""
    cut, fill = (F.coalesce(F.sum(F.when(F.col("class") == k, F.abs("dz"))), F.lit(0.0)) * cell_area for k in ("cut", "fill"))
    return changes.agg(cut.alias("cut_volume"), fill.alias("fill_volume"), (fill - cut).alias("net_volume"), *(F.count_if(F.col("class") == k).alias(f"{k}_cells") for k in ("cut", "fill", "unchanged")))


def surface_volume(cells: DataFrame, plane: float, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Per direction from the plane the flat and sloped area, volume and cells; cells at the plane count in both. Slopes are
    central differences, one-sided beside no data."""
    near = _gathered(cells, [(0, -1), (0, 1), (-1, 0), (1, 0)]).where("n0 IS NOT NULL")

    def slope(a: str, b: str, step: float) -> Column:
        both = (F.col(b) - F.col(a)) / (2 * step)
        return F.coalesce(both, (F.col("n0") - F.col(a)) / step, (F.col(b) - F.col("n0")) / step, F.lit(0.0))

    gx, gy = slope("n1", "n2", dx), slope("n3", "n4", dy)
    sides = F.array_compact(F.array(F.when(F.col("n0") >= plane, "above"), F.when(F.col("n0") <= plane, "below")))
    rows = near.select(F.explode(sides).alias("direction"), F.abs(F.col("n0") - plane).alias("h"), F.sqrt(1.0 + gx * gx + gy * gy).alias("f"))
    return rows.groupBy("direction").agg((F.count("*") * dx * dy).alias("area_2d"), (F.sum("f") * dx * dy).alias("area_3d"), (F.sum("h") * dx * dy).alias("volume"), F.count("*").alias("n_cells"))


def focal_flow(cells: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per cell the mask of the neighbours that lie more than ``threshold`` above it and so flow in."""
    near = _gathered(cells, AROUND)
    mask = sum((F.when(F.col(f"n{k + 1}") - F.col("n0") > threshold, 1 << k).otherwise(0) for k in range(8)), F.lit(0))
    return near.select(*CELL, F.when(F.col("n0").isNotNull(), mask).cast("double").alias("v"))


def expand_shrink(cells: DataFrame, classes: list[float], times: int, mode: str = "expand") -> DataFrame:
    """Classes grown into, or shrunk in favour of, their neighbours by so many cells: each step a cell takes the most frequent
    class around it, the smallest of several."""
    if mode not in ("expand", "shrink"):
        raise ValueError("mode must be expand or shrink")
    for _ in range(times):
        near = _gathered(cells, AROUND)
        chosen = F.col("n0").isin(*classes)
        others = F.filter(F.array(*(F.col(f"n{k}") for k in range(1, 9))), lambda x: x.isNotNull() & (x.isin(*classes) if mode == "expand" else ~x.isin(*classes)))
        moves = F.col("n0").isNotNull() & (~chosen if mode == "expand" else chosen) & (F.size(others) > 0)
        cells = near.select(*CELL, F.when(moves, _by_count(others, -1)).otherwise(F.col("n0")).alias("v"))
    return cells


def storage_capacity(cells: DataFrame, levels: int = 10, increment: float | None = None, cell_area: float = 1.0) -> DataFrame:
    """Per zone (cells row, col, zone, v) and level from its least to its greatest value the area and volume below it."""
    valid = cells.where("v IS NOT NULL AND zone IS NOT NULL")
    lo, hi = F.col("lo"), F.col("hi")
    if increment is None:
        steps = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda i: lo + (hi - lo) * i / levels)
    else:
        inner = F.sequence(F.lit(0).cast("long"), F.ceil((hi - lo) / increment) - 1)
        steps = F.concat(F.transform(inner, lambda i: lo + i * increment), F.array(hi))
    ends = valid.groupBy("zone").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    ends = ends.select("zone", F.when(hi > lo, steps).otherwise(F.array(hi)).alias("steps"))
    rows = valid.join(ends, "zone").select("zone", "v", F.posexplode("steps").alias("level", "elevation"))
    below = F.col("v") <= F.col("elevation")
    return rows.groupBy("zone", "level", "elevation").agg((F.count_if(below) * cell_area).alias("area"), (F.sum(F.when(below, F.col("elevation") - F.col("v")).otherwise(0.0)) * cell_area).alias("volume"))


def detect_image_anomalies(cells: DataFrame, layers: list[int]) -> DataFrame:
    """The squared Mahalanobis distance of every cell that has all layers from the mean of these, with a ridge of a millionth of
    the mean variance. One row of moments reaches the driver."""
    wide = cells.where(F.col("layer").isin(*layers)).groupBy(*CELL).agg(*(F.max(F.when(F.col("layer") == k, F.col("v"))).cast("double").alias(f"b{k}") for k in layers))
    valid = wide.na.drop()
    pairs = [(a, b) for i, a in enumerate(layers) for b in layers[i:]]
    m = valid.agg(*(F.avg(f"b{k}").alias(f"m{k}") for k in layers), *(F.covar_pop(f"b{a}", f"b{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
    if m[f"m{layers[0]}"] is None:
        return valid.select(*CELL, F.lit(None).cast("double").alias("v"))
    at = {k: i for i, k in enumerate(layers)}
    cov = np.zeros((len(layers), len(layers)))
    for a, b in pairs:
        cov[at[a], at[b]] = cov[at[b], at[a]] = m[f"c{a}_{b}"]
    inverse = np.linalg.inv(cov + np.eye(len(layers)) * 1e-6 * max(np.trace(cov) / len(layers), 1e-12))
    away = {k: F.col(f"b{k}") - m[f"m{k}"] for k in layers}
    score = sum((float(inverse[at[a], at[b]]) * away[a] * away[b] for a in layers for b in layers), F.lit(0.0))
    return valid.select(*CELL, F.greatest(score, F.lit(0.0)).alias("v"))
