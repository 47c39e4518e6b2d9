"""Registered queries of the surface operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import surfaces as S
from .rasters import AT, CELLS, _cells, _labelled, _union, _zones
from .registry import query, rounded

_L = "l AS (SELECT y, x, CAST(v AS DOUBLE) AS v FROM c WHERE k = 1)"
_T = f"{_L}, f AS (SELECT y, x, v, min(v) OVER () AS lo, max(v) OVER () AS hi, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS t FROM l)"
_LOGISTIC = "((1 / (1 + exp(-10 * (t - 0.5))) - 1 / (1 + exp(5.0::DOUBLE))) / (1 / (1 + exp(-5.0::DOUBLE)) - 1 / (1 + exp(5.0::DOUBLE))))"
_AWAY = "((v - (lo + hi) / 2) / ((hi - lo) / 6))"
_SHAPES = {
    "linear": "t", "inverse_linear": "1 - t", "power": "t ** 2", "exponential": "(exp(5 * t) - 1) / (exp(5.0::DOUBLE) - 1)", "logarithmic": "ln(1 + 9 * t) / ln(10)", "logistic": _LOGISTIC, "large": _LOGISTIC,
    "small": f"1 - {_LOGISTIC}", "gaussian": f"exp(-0.5::DOUBLE * {_AWAY} ** 2)", "near": f"1 / (1 + {_AWAY} ** 2)", "symmetric_linear": "1 - abs(2 * t - 1)",
}


def _layer(spark, sf_dir, k=1):
    return _cells(spark, sf_dir).where(F.col("layer") == k).select("row", "col", F.col("v").cast("double").alias("v"))


@query(f"WITH {CELLS}, {_T} " + _union({k: f"CASE WHEN v > hi - 1 THEN 7 ELSE 1 + greatest(0, least(1, {e})) * 9 END" if k == "linear" else f"1 + greatest(0, least(1, {e})) * 9" for k, e in _SHAPES.items()}, "f WHERE v IS NOT NULL"))
def rescale_by_function(spark, sf_dir):
    rows = _layer(spark, sf_dir).where("v IS NOT NULL")
    top = rows.agg(F.max("v")).first()[0]
    made = {k: S.rescale_by_function(rows, k, 1.0, 10.0, high=top - 1 if k == "linear" else None, above=7.0) for k in _SHAPES}
    return rounded(_labelled(made), "v")


_UNITS = {"linear_to_db": "CASE WHEN v > 0 THEN 10 * log10(v) END", "db_to_linear": "10.0::DOUBLE ** (v / 1000)", "amplitude_to_intensity": "v * v", "intensity_to_amplitude": "sqrt(v)", "phase_to_displacement": "-v * 0.05546576 / (4 * pi())"}


@query(f"WITH {CELLS}, {_L} {_union(_UNITS, 'l')}")
def convert_sar_units(spark, sf_dir):
    rows = _layer(spark, sf_dir)
    return rounded(_labelled({k: S.convert_sar_units(rows.withColumn("v", F.col("v") / 100) if k == "db_to_linear" else rows, k) for k in _UNITS}), "v")


_POL = "p AS (SELECT y, x, CAST(max(v) FILTER (k = 1) AS DOUBLE) AS hh, CAST(max(v) FILTER (k = 2) AS DOUBLE) AS hv, CAST(max(v) FILTER (k = 3) AS DOUBLE) AS vh, CAST(max(v) FILTER (k = 4) AS DOUBLE) AS vv FROM c GROUP BY y, x)"


@query(f"WITH {CELLS}, {_POL} " + _union({"rvi": "coalesce(8 * hv / (hh + vv + 2 * hv), 4 * vh / (vv + vh))", "rfdi": "(hh - hv) / (hh + hv)", "csi": "vv / (vv + hh)", "dpsvi": "vh * (vv + vh) / vv"}, "p"))
def compute_sar_indices(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return rounded(_labelled({k: S.compute_sar_indices(c, k, {"hh": 1, "hv": 2, "vh": 3, "vv": 4}) for k in ("rvi", "rfdi", "csi", "dpsvi")}), "v")


@query(f"WITH {CELLS}, {_L} " + _union({"beta0": "v * v / 9", "sigma0": "v * v / 9 * sin(radians(35))", "gamma0": "CASE WHEN v > 0 THEN 10 * log10(v / 9 * tan(radians(35))) END"}, "l"))
def apply_radiometric_calibration(spark, sf_dir):
    rows = _layer(spark, sf_dir)
    made = {"beta0": S.apply_radiometric_calibration(rows, "beta0", 3.0), "sigma0": S.apply_radiometric_calibration(rows, "sigma0", 3.0, 35.0), "gamma0": S.apply_radiometric_calibration(rows, "gamma0", 3.0, 35.0, "intensity", True)}
    return rounded(_labelled(made), "v")


@query(f"""WITH {CELLS}, {_L}, b AS (SELECT CAST(floor(y / 5) AS BIGINT) AS y, CAST(floor(x / 3) AS BIGINT) AS x, avg(v) AS i, avg(v * v) AS a, quantile_cont(v, 0.5) AS m FROM l GROUP BY ALL)
 {_union({"mean": "i", "amplitude": "sqrt(a)", "median_db": "CASE WHEN m > 0 THEN 10 * log10(m) END"}, "b")}""")
def multilook(spark, sf_dir):
    rows = _layer(spark, sf_dir)
    made = {"mean": S.multilook(rows, 3, 5), "amplitude": S.multilook(rows, 3, 5, True, "amplitude"), "median_db": S.multilook(rows, 3, 5, False, "db", "median")}
    return rounded(_labelled(made), "v")


@query(f"""WITH {CELLS}, j AS (SELECT a.y, a.x, CAST(a.v + b.v AS DOUBLE) AS v FROM c a JOIN c b ON a.y = b.y AND a.x = b.x AND a.k = 1 AND b.k = 2), m AS (SELECT *, min(v) OVER () * (1 + 40 / 100.0::DOUBLE) AS t FROM j)
 {_union({"all": "v", "near": "CASE WHEN v <= t THEN v END"}, "m")}""")
def corridor(spark, sf_dir):
    a, b = _layer(spark, sf_dir), _layer(spark, sf_dir, 2)
    return rounded(_labelled({"all": S.corridor(a, b), "near": S.corridor(a, b, percent=40.0)}), "v")


_DZ = "d AS (SELECT a.y, a.x, CAST(b.v - a.v AS DOUBLE) AS dz FROM c a JOIN c b ON a.y = b.y AND a.x = b.x AND a.k = 1 AND b.k = 2 WHERE a.v IS NOT NULL AND b.v IS NOT NULL), e AS (SELECT *, CASE WHEN dz > 5 THEN 'fill' WHEN dz < -5 THEN 'cut' ELSE 'unchanged' END AS class FROM d)"


@query(f"WITH {CELLS}, {_DZ} SELECT {AT}, dz, class FROM e")
def cut_fill(spark, sf_dir):
    return S.cut_fill(_layer(spark, sf_dir), _layer(spark, sf_dir, 2), tolerance=5.0)


@query(f"""WITH {CELLS}, {_DZ}, v AS (SELECT coalesce(sum(-dz) FILTER (class = 'cut'), 0) * 4 AS a, coalesce(sum(dz) FILTER (class = 'fill'), 0) * 4 AS b, count(*) FILTER (class = 'cut') AS cut_cells, count(*) FILTER (class = 'fill') AS fill_cells, count(*) FILTER (class = 'unchanged') AS unchanged_cells FROM e)
 SELECT a AS cut_volume, b AS fill_volume, b - a AS net_volume, cut_cells, fill_cells, unchanged_cells FROM v""")
def cut_fill_volumes(spark, sf_dir):
    return S.cut_fill_volumes(S.cut_fill(_layer(spark, sf_dir), _layer(spark, sf_dir, 2), tolerance=5.0), 4.0)


def _step(dy: int, dx: int) -> str:
    return f"LEFT JOIN l n{dy + 1}{dx + 1} ON n{dy + 1}{dx + 1}.y = l.y + {dy} AND n{dy + 1}{dx + 1}.x = l.x + {dx}"


def _slope(a: str, b: str, step: float) -> str:
    return f"coalesce(({b}.v - {a}.v) / {2 * step}, (l.v - {a}.v) / {step}, ({b}.v - l.v) / {step}, 0)"


@query(f"""WITH {CELLS}, {_L}, g AS (SELECT l.v, {_slope("n10", "n12", 2.0)} AS gx, {_slope("n01", "n21", 3.0)} AS gy FROM l {_step(0, -1)} {_step(0, 1)} {_step(-1, 0)} {_step(1, 0)} WHERE l.v IS NOT NULL), s AS (SELECT 'above' AS direction, v - 30 AS h, gx, gy FROM g WHERE v >= 30 UNION ALL SELECT 'below', 30 - v, gx, gy FROM g WHERE v <= 30)
 SELECT direction, count(*) * 6.0::DOUBLE AS area_2d, round(sum(sqrt(1 + gx * gx + gy * gy)) * 6, 6) AS area_3d, round(sum(h) * 6, 6) AS volume, count(*) AS n_cells FROM s GROUP BY direction""")
def surface_volume(spark, sf_dir):
    return rounded(S.surface_volume(_layer(spark, sf_dir), 30.0, 2.0, 3.0), "area_3d", "volume")


_AROUND = "(VALUES " + ", ".join(f"({r}, {c}, {1 << k})" for k, (r, c) in enumerate(S.AROUND)) + ") o(dr, dc, w)"


@query(f"""WITH {CELLS}, {_L} SELECT a.y AS "row", a.x AS col, CAST(CASE WHEN max(a.v) IS NOT NULL THEN coalesce(sum(o.w) FILTER (b.v - a.v > 2), 0) END AS DOUBLE) AS v FROM l a CROSS JOIN {_AROUND} LEFT JOIN l b ON b.y = a.y + dr AND b.x = a.x + dc GROUP BY a.y, a.x""")
def focal_flow(spark, sf_dir):
    return S.focal_flow(_layer(spark, sf_dir), 2.0)


def _grown(test: str, other: str, kind: str) -> str:
    return f"""SELECT a.y AS "row", a.x AS col, coalesce((SELECT v FROM n WHERE n.y = a.y AND n.x = a.x AND n.v {other} AND a.v {test} ORDER BY n.c DESC, n.v LIMIT 1), a.v) AS v, '{kind}' AS kind FROM q a"""


@query(f"""WITH {CELLS}, {_L}, q AS (SELECT y, x, CAST(v % 4 AS DOUBLE) AS v FROM l), n AS (SELECT a.y, a.x, b.v, count(*) AS c FROM q a CROSS JOIN {_AROUND} JOIN q b ON b.y = a.y + dr AND b.x = a.x + dc WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL)
 {_grown("NOT IN (1, 3)", "IN (1, 3)", "expand")} UNION ALL {_grown("IN (1, 3)", "NOT IN (1, 3)", "shrink")}""")
def expand_shrink(spark, sf_dir):
    rows = _layer(spark, sf_dir).withColumn("v", F.col("v") % 4)
    return _labelled({m: S.expand_shrink(rows, [1.0, 3.0], 1, m) for m in ("expand", "shrink")})


@query(f"""WITH {CELLS}, q AS (SELECT zone, CAST(v AS DOUBLE) AS v FROM c JOIN z ON z.y = c.y AND z.x = c.x WHERE k = 1 AND v IS NOT NULL), e AS (SELECT zone, min(v) AS lo, max(v) AS hi FROM q GROUP BY zone),
 s AS (SELECT zone, CAST(i AS INT) AS level, lo + (hi - lo) * i / 4 AS elevation FROM e, range(0, 5) r(i) WHERE hi > lo UNION ALL SELECT zone, 0, hi FROM e WHERE hi = lo)
 SELECT zone, level, round(elevation, 6) AS elevation, count(*) FILTER (v <= elevation) * 2.0::DOUBLE AS area, round(coalesce(sum(elevation - v) FILTER (v <= elevation), 0) * 2, 6) AS volume FROM s JOIN q USING (zone) GROUP BY ALL""")
def storage_capacity(spark, sf_dir):
    zones = _zones(_cells(spark, sf_dir))
    return rounded(S.storage_capacity(_layer(spark, sf_dir).join(zones, ["row", "col"]), 4, cell_area=2.0), "elevation", "volume")


@query(f"""WITH {CELLS}, {_POL}, w AS (SELECT * FROM p WHERE hh IS NOT NULL AND hv IS NOT NULL), m AS (SELECT avg(hh) AS ma, avg(hv) AS mb, var_pop(hh) AS a, var_pop(hv) AS b, covar_pop(hh, hv) AS c FROM w), r AS (SELECT ma, mb, a + 1e-6 * (a + b) / 2 AS a, b + 1e-6 * (a + b) / 2 AS b, c FROM m)
 SELECT {AT}, round((b * (hh - ma) ** 2 - 2 * c * (hh - ma) * (hv - mb) + a * (hv - mb) ** 2) / (a * b - c * c), 5) AS v FROM w, r""")
def detect_image_anomalies(spark, sf_dir):
    return S.detect_image_anomalies(_cells(spark, sf_dir), [1, 2]).withColumn("v", F.round("v", 5))
