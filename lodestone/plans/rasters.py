"""Registered queries of the raster operators, over a stack of seven layers of 24 by 8 cells that the
line items make, each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster as R
from .registry import query, read, rounded

LAYERS = [1, 2, 3, 4, 5, 6, 7]


def _cells(spark, sf_dir):
    sums = read(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_partkey") % 24).alias("row"), (F.col("l_suppkey") % 8).alias("col"), F.col("l_linenumber").alias("layer")
    ).agg(F.sum("l_quantity").alias("s"))
    return sums.select("row", "col", "layer", F.when(F.col("s") % 11 != 0, F.col("s")).alias("v"))


def _zones(cells):
    """Zones of five rows and four columns, with a second zoning of seven rows."""
    return cells.select("row", "col").distinct().withColumn("zone", F.floor(F.col("row") / 5) * 10 + F.floor(F.col("col") / 4))


def _labelled(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(k)) for k, df in frames.items()])


CELLS = """c AS (SELECT y, x, k, CASE WHEN s % 11 <> 0 THEN s END AS v FROM (SELECT l_partkey % 24 AS y, l_suppkey % 8 AS x, l_linenumber AS k, sum(l_quantity) AS s FROM lineitem GROUP BY ALL)),
z AS (SELECT DISTINCT y, x, CAST(floor(y / 5.0) * 10 + floor(x / 4.0) AS BIGINT) AS zone FROM c)"""
AT = 'y AS "row", x AS col'
_PICK = "list_min(list_transform(list_distinct(l), lambda a: {{'n': {sign}len(list_filter(l, lambda b: b = a)), 'v': a}})).v"
MAJORITY, MINORITY = _PICK.format(sign="-"), _PICK.format(sign="")


def _union(kinds: dict[str, str], source: str, also: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {AT}{also}, round(CAST({e} AS DOUBLE), 6) + 0.0::DOUBLE AS v, '{k}' AS kind FROM {source}" for k, e in kinds.items())


_STATS = {
    "mean": "avg(v)", "majority": MAJORITY, "maximum": "max(v)", "median": "quantile_cont(v, 0.5)", "minimum": "min(v)", "minority": MINORITY,
    "percentile": "quantile_cont(v, 0.9)", "range": "max(v) - min(v)", "std": "stddev_pop(v)", "sum": "sum(v)", "variety": "count(DISTINCT v)",
}


def _stats(source: str, keys: str, out: str = AT) -> str:
    """Every statistic of groups of ``source`` as rows."""
    parts = []
    for k, e in _STATS.items():
        if k in ("majority", "minority"):
            parts.append(f"SELECT {out}, round(CAST({e} AS DOUBLE), 6) + 0.0::DOUBLE AS v, '{k}' AS kind FROM (SELECT {keys}, list(v) FILTER (v IS NOT NULL) AS l FROM {source} GROUP BY ALL)")
        else:
            parts.append(f"SELECT {out}, round(CAST({e} AS DOUBLE), 6) + 0.0::DOUBLE AS v, '{k}' AS kind FROM {source} GROUP BY {keys}")
    return " UNION ALL ".join(parts)


@query(f"WITH {CELLS} {_stats('c', 'y, x')}")
def cell_statistics(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return rounded(_labelled({s: R.cell_statistics(c, s) for s in R.STATISTICS}), "v")


@query(f"""WITH {CELLS}, p AS (SELECT *, dense_rank() OVER (PARTITION BY y, x ORDER BY k) AS i FROM c), l AS (SELECT y, x, list_sort(list(v) FILTER (v IS NOT NULL)) AS l FROM p GROUP BY ALL),
 h AS (SELECT y, x, list_filter(list_distinct(l), lambda a: len(list_filter(l, lambda b: b = a)) = 1) AS h FROM l)
 SELECT {AT}, CAST((SELECT min(i) FROM p q WHERE q.y = l.y AND q.x = l.x AND q.v = l.l[-1]) AS DOUBLE) AS v, 'highest_position' AS kind FROM l
 UNION ALL SELECT {AT}, CAST((SELECT min(i) FROM p q WHERE q.y = l.y AND q.x = l.x AND q.v = l.l[1]) AS DOUBLE), 'lowest_position' FROM l
 UNION ALL SELECT {AT}, l[2], 'rank' FROM l UNION ALL SELECT {AT}, CASE WHEN len(h) = 1 THEN h[1] END, 'popularity' FROM h""")
def cell_position_statistics(spark, sf_dir):
    c = _cells(spark, sf_dir)
    kinds = {"highest_position": None, "lowest_position": None, "rank": 2, "popularity": 1}
    return _labelled({k: R.cell_position_statistics(c, k, n) for k, n in kinds.items()})


@query(f"""WITH {CELLS}, p AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY y, x ORDER BY k) - 1 AS i FROM c) WHERE v IS NOT NULL),
 h AS (SELECT *, CAST(v > 20 AS INT) AS h FROM p), r AS (SELECT *, i - sum(h) OVER (PARTITION BY y, x ORDER BY k) AS r FROM h),
 n AS (SELECT y, x, r, sum(h) AS n FROM r GROUP BY ALL), s AS (SELECT y, x, list_sort(list({{'v': v, 'i': i}})) AS s FROM p GROUP BY ALL)
 SELECT {AT}, CAST(arg_max(i, {{'v': v, 'j': -i}}) AS DOUBLE) AS v, 'argmax' AS kind FROM p GROUP BY y, x UNION ALL SELECT {AT}, CAST(arg_min(i, {{'v': v, 'j': i}}) AS DOUBLE), 'argmin' FROM p GROUP BY y, x
 UNION ALL SELECT {AT}, CAST(s[CAST(floor((len(s) - 1) / 2) AS INT) + 1].i AS DOUBLE), 'median_position' FROM s
 UNION ALL SELECT {AT}, CAST(sum(h) AS DOUBLE), 'duration' FROM h GROUP BY y, x UNION ALL SELECT {AT}, CAST(max(n) AS DOUBLE), 'longest_run' FROM n GROUP BY y, x""")
def find_argument_statistics(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return _labelled({k: R.find_argument_statistics(c, k, 20.0) for k in ("argmax", "argmin", "median_position", "duration", "longest_run")})


@query(f"""WITH {CELLS}, r AS (SELECT y, x, v AS r FROM c WHERE k = 1), j AS (SELECT r.y, r.x, r, v FROM r JOIN c ON c.y = r.y AND c.x = r.x)
 SELECT {AT}, count(*) FILTER (v > r) AS v, 'greater' AS kind FROM j GROUP BY y, x UNION ALL SELECT {AT}, count(*) FILTER (abs(v - r) <= 5), 'equal' FROM j GROUP BY y, x
 UNION ALL SELECT {AT}, count(*) FILTER (v <= r), 'less_equal' FROM j GROUP BY y, x""")
def frequency_comparison(spark, sf_dir):
    c = _cells(spark, sf_dir)
    base = c.where("layer = 1")
    return _labelled({k: R.frequency_comparison(base, c, k, 5.0) for k in ("greater", "equal", "less_equal")})


_WIDE = "w AS (SELECT y, x, " + ", ".join(f"max(v) FILTER (k = {k}) AS b{k - 1}" for k in LAYERS) + " FROM c GROUP BY ALL), f AS (SELECT * FROM w WHERE " + " AND ".join(f"b{k - 1} IS NOT NULL" for k in LAYERS[:3]) + ")"


@query(f"""WITH {CELLS}, {_WIDE} SELECT 1 AS a, 2 AS b, round(covar_pop(b0, b1), 6) AS covariance, round(corr(b0, b1), 6) AS correlation FROM f UNION ALL SELECT 1, 3, round(covar_pop(b0, b2), 6), round(corr(b0, b2), 6) FROM f
 UNION ALL SELECT 2, 3, round(covar_pop(b1, b2), 6), round(corr(b1, b2), 6) FROM f UNION ALL SELECT 1, 1, round(var_pop(b0), 6), 1.0 FROM f UNION ALL SELECT 2, 2, round(var_pop(b1), 6), 1.0 FROM f UNION ALL SELECT 3, 3, round(var_pop(b2), 6), 1.0 FROM f""")
def band_collection_statistics(spark, sf_dir):
    return rounded(R.band_collection_statistics(_cells(spark, sf_dir), LAYERS[:3])[1], "covariance", "correlation")


@query(f"""WITH {CELLS}, s AS (SELECT y, x, k - 1 AS layer, v FROM c WHERE k IN (2, 3)), n AS (SELECT *, count(v) OVER (PARTITION BY y, x) AS n FROM s) SELECT {AT}, layer, CASE WHEN n = 2 THEN v END AS v FROM n""")
def composite_bands(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return R.composite_bands([c.where("layer = 2"), c.where("layer = 3")])


@query(f"""WITH {CELLS}, {_WIDE}, t AS (SELECT b0, b1, row_number() OVER (ORDER BY b0, b1) AS id FROM (SELECT DISTINCT b0, b1 FROM w WHERE b0 IS NOT NULL AND b1 IS NOT NULL)) SELECT {AT}, id FROM w JOIN t USING (b0, b1)""")
def combine(spark, sf_dir):
    return R.combine(_cells(spark, sf_dir), LAYERS[:2])[0]


@query(f"""WITH {CELLS}, m AS (SELECT *, min(v) OVER (PARTITION BY k) AS lo, max(v) OVER (PARTITION BY k) AS hi FROM c) SELECT {AT}, k AS layer, round((v - lo) / (hi - lo), 6) AS v FROM m""")
def raster_normalize(spark, sf_dir):
    return rounded(R.raster_normalize(_cells(spark, sf_dir)), "v")


@query(f"""WITH {CELLS}, {_WIDE} SELECT {AT}, round((b1 - b0) / (b1 + b0), 6) AS v, 'ndvi' AS kind FROM w UNION ALL SELECT {AT}, round((b2 - b1) / (b2 + b1), 6), 'ndwi' FROM w UNION ALL SELECT {AT}, round((b4 - b1) / (b4 + b1), 6), 'ndbi' FROM w
 UNION ALL SELECT {AT}, round((b1 - b4) / (b1 + b4), 6), 'nbr' FROM w UNION ALL SELECT {AT}, CASE WHEN b1 + 6.0 * b0 - 7.5 * b3 + 1.0 <> 0 THEN round(CAST(2.5 * (b1 - b0) / (b1 + 6.0 * b0 - 7.5 * b3 + 1.0) AS DOUBLE), 6) + 0.0::DOUBLE END, 'evi' FROM w
 UNION ALL SELECT {AT}, round(1.5 * (b1 - b0) / (b1 + b0 + 0.5), 6), 'savi' FROM w""")
def spectral_index(spark, sf_dir):
    bands = R.wide(_cells(spark, sf_dir), LAYERS)
    return rounded(_labelled({k: R.spectral_index(bands, k, "b0", "b1", "b2", "b3", "b4") for k in ("ndvi", "ndwi", "ndbi", "nbr", "evi", "savi")}), "v")


@query(f"""WITH {CELLS}, {_WIDE}, o AS (SELECT y, x, b0, b1, b2, list_reverse_sort([b0 * 0.5 * 3, b1 * 0.3 * 3, b2 * 0.2 * 3]) AS o FROM f)
 SELECT {AT}, round(b0 * 0.5 + b1 * 0.3 + b2 * 0.2, 6) AS v, 'weighted_sum' AS kind FROM f UNION ALL SELECT {AT}, round(exp(0.5 * ln(b0) + 0.3 * ln(b1) + 0.2 * ln(b2)), 6), 'weighted_geometric_mean' FROM f
 UNION ALL SELECT {AT}, round(o[1] * 0.6 + o[2] * 0.3 + o[3] * 0.1, 6), 'owa' FROM o""")
def multicriteria_overlay(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return rounded(_labelled({m: R.multicriteria_overlay(c, LAYERS[:3], m, [5.0, 3.0, 2.0], [6.0, 3.0, 1.0]) for m in ("weighted_sum", "weighted_geometric_mean", "owa")}), "v")


_MEMBER = "m AS (SELECT y, x, k, v AS raw, (v - min(v) OVER (PARTITION BY k)) / (max(v) OVER (PARTITION BY k) - min(v) OVER (PARTITION BY k)) AS m, avg(v) OVER (PARTITION BY k) AS mid FROM c)"


@query(f"""WITH {CELLS}, {_MEMBER}, l AS (SELECT y, x, list(m) FILTER (m IS NOT NULL) AS l, min(m) AS lo, max(m) AS hi FROM m GROUP BY ALL), p AS (SELECT y, x, lo, hi, list_product(l) AS p, 1 - list_product(list_transform(l, lambda a: 1 - a)) AS s FROM l)
 {_union({"and": "lo", "or": "hi", "product": "p", "sum": "s", "gamma": "pow(s, 0.9) * pow(p, 1.0 - 0.9)"}, "p")}""")
def fuzzy_overlay(spark, sf_dir):
    m = R.fuzzy_membership(_cells(spark, sf_dir))
    return rounded(_labelled({k: R.fuzzy_overlay(m, k) for k in ("and", "or", "product", "sum", "gamma")}), "v")


@query(f"""WITH {CELLS}, m AS (SELECT *, min(v) OVER (PARTITION BY k) AS lo, max(v) OVER (PARTITION BY k) AS hi, quantile_cont(v, [0.25, 0.5, 0.75]) OVER (PARTITION BY k) AS q FROM c)
 SELECT {AT}, k AS layer, CASE WHEN v IS NOT NULL THEN 1 + len(list_filter([lo + (hi - lo) * 1 / 4, lo + (hi - lo) * 2 / 4, lo + (hi - lo) * 3 / 4], lambda b: v > b)) END AS zone, 'equal_interval' AS kind FROM m
 UNION ALL SELECT {AT}, k, CASE WHEN v IS NOT NULL THEN 1 + len(list_filter(q, lambda b: v > b)) END, 'equal_area' FROM m""")
def slice_raster(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return _labelled({k: R.slice_raster(c, 4, k) for k in ("equal_interval", "equal_area")})


_TREND = "t AS (SELECT y, x, regr_slope(v, k) AS s, regr_intercept(v, k) AS i, CASE WHEN var_pop(v) = 0 THEN 1.0 ELSE regr_r2(v, k) END AS r2, count(v) AS n FROM c WHERE v IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {CELLS}, {_TREND} SELECT {AT}, CASE WHEN n >= 3 THEN round(s, 6) + 0.0::DOUBLE END AS slope, CASE WHEN n >= 3 THEN round(i, 6) END AS intercept, CASE WHEN n >= 3 THEN round(CAST(r2 AS DOUBLE), 6) END AS r2, n FROM t""")
def generate_trend_raster(spark, sf_dir):
    return rounded(R.generate_trend_raster(_cells(spark, sf_dir)), "slope", "intercept", "r2")


@query(f"""WITH {CELLS}, {_TREND} SELECT {AT}, layer, CASE WHEN n >= 3 THEN round(i + s * layer, 6) END AS v FROM t, (VALUES (8.0::DOUBLE), (10.0::DOUBLE)) u(layer)""")
def predict_using_trend_raster(spark, sf_dir):
    return rounded(R.predict_using_trend_raster(R.generate_trend_raster(_cells(spark, sf_dir)), [8, 10]), "v")


_ANOMALY = "a AS (SELECT *, avg(v) OVER w AS m, quantile_cont(v, 0.5) OVER w AS q, stddev_pop(v) OVER w AS s FROM c WINDOW w AS (PARTITION BY y, x))"


@query(f"""WITH {CELLS}, {_ANOMALY} {_union({"difference_from_mean": "v - m", "difference_from_median": "v - q", "percent_of_mean": "100 * v / m", "z_score": "CASE WHEN v IS NULL THEN NULL WHEN s = 0 THEN 0 ELSE (v - m) / s END"}, "a", ", k AS layer")}""")
def multidimensional_anomaly(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return rounded(_labelled({k: R.multidimensional_anomaly(c, k) for k in ("difference_from_mean", "difference_from_median", "percent_of_mean", "z_score")}), "v")


@query(f"""WITH {CELLS}, d AS (SELECT y, x, k, (v * 7) % 13 + v AS w FROM c), b AS (SELECT c.y, c.x, v, w FROM c JOIN d ON c.y = d.y AND c.x = d.x AND c.k = d.k - 1 WHERE v IS NOT NULL AND w IS NOT NULL)
 SELECT {AT}, CASE WHEN count(*) >= 3 THEN round(corr(v, w), 6) + 0.0::DOUBLE END AS r, count(*) AS n FROM b GROUP BY y, x""")
def multidimensional_raster_correlation(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return rounded(R.multidimensional_raster_correlation(c, c.withColumn("v", (F.col("v") * 7) % 13 + F.col("v")), lag=1), "r")


_MOVING = "g AS (SELECT *, count(v) OVER w AS n, avg(v) OVER w AS a, max(v) OVER w AS hi, min(v) OVER w AS lo, sum(v) OVER w AS s, stddev_pop(v) OVER w AS d, row_number() OVER (PARTITION BY y, x ORDER BY k) AS i FROM c WINDOW w AS (PARTITION BY y, x ORDER BY k ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)), m AS (SELECT g.y, g.x, g.k, list(o.v) FILTER (o.v IS NOT NULL) AS l, quantile_cont(o.v, 0.5) AS q FROM g JOIN g o ON o.y = g.y AND o.x = g.x AND o.i BETWEEN g.i - 2 AND g.i + 1 GROUP BY ALL)"


@query(f"""WITH {CELLS}, {_MOVING} {_union({"mean": "a", "maximum": "hi", "minimum": "lo", "sum": "s", "std": "d"}, "g", ", k AS layer")}
 UNION ALL {_union({"median": "q", "majority": MAJORITY, "minority": MINORITY}, "m", ", k AS layer")}""")
def dimensional_moving_statistics(spark, sf_dir):
    c = _cells(spark, sf_dir)
    kinds = ("mean", "maximum", "minimum", "sum", "std", "median", "majority", "minority")
    return rounded(_labelled({s: R.dimensional_moving_statistics(c, s, 2, 1) for s in kinds}), "v")


@query(f"""WITH {CELLS}, b AS (SELECT *, CAST(floor((k - 1) / 3.0) AS BIGINT) AS slice FROM c) {_stats("b", "y, x, slice", AT + ", slice")}""")
def aggregate_multidimensional_raster(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return rounded(_labelled({s: R.aggregate_multidimensional_raster(c, s, 3.0, 1.0) for s in R.STATISTICS}), "v")


@query(f"""WITH {CELLS}, e AS (SELECT y, x, k, v, 0 AS i FROM c WHERE k <= 5 UNION ALL SELECT y, x, k, v + 1000, 1 FROM c WHERE k >= 3),
 g AS (SELECT y, x, k, arg_min(v, i) FILTER (v IS NOT NULL) AS first, arg_max(v, i) FILTER (v IS NOT NULL) AS last, avg(v) AS mean FROM e GROUP BY ALL) {_union({"first": "first", "last": "last", "mean": "mean"}, "g", ", k AS layer")}""")
def merge_multidimensional_rasters(spark, sf_dir):
    c = _cells(spark, sf_dir)
    cubes = [c.where("layer <= 5"), c.where("layer >= 3").withColumn("v", F.col("v") + 1000)]
    return rounded(_labelled({k: R.merge_multidimensional_rasters(cubes, k) for k in ("first", "last", "mean")}), "v")


@query(f"WITH {CELLS} SELECT {AT}, k AS layer, v FROM c WHERE k IN (2, 4, 6)")
def subset_multidimensional_raster(spark, sf_dir):
    return R.subset_multidimensional_raster(_cells(spark, sf_dir), between=(2, 7), step=2)


@query(f"""WITH {CELLS}, q AS (SELECT k, CAST(v % 5 AS BIGINT) AS class FROM c WHERE v IS NOT NULL), g AS (SELECT k, class, count(*) AS cell_count FROM q GROUP BY ALL)
 SELECT k AS layer, class, cell_count, round(100.0::DOUBLE * cell_count / sum(cell_count) OVER (PARTITION BY k), 6) AS percent, cell_count * 2.5::DOUBLE AS area FROM g""")
def summarize_categorical_raster(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("v", F.col("v") % 5)
    return rounded(R.summarize_categorical_raster(c, 2.5), "percent")


@query(f"""WITH {CELLS}, b AS (SELECT *, floor(y / 5.0) AS br, floor(x / 3.0) AS bc FROM c), g AS (SELECT k, br, bc, avg(v) AS mean, sum(v) AS sum, stddev_pop(v) AS std, quantile_cont(v, 0.5) AS median FROM b GROUP BY ALL), j AS (SELECT b.y, b.x, b.k, mean, sum, std, median FROM b JOIN g USING (k, br, bc))
 {_union({"mean": "mean", "sum": "sum", "std": "std", "median": "median"}, "j", ", k AS layer")}""")
def block_statistics(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return rounded(_labelled({s: R.block_statistics(c, s, 5, 3) for s in ("mean", "sum", "std", "median")}), "v")


@query(f"""WITH {CELLS}, j AS (SELECT c.y, c.x, c.k, avg(d.v) AS mean, max(d.v) AS maximum, count(DISTINCT d.v) AS variety, count(d.v) AS n FROM c JOIN c d ON d.k = c.k AND abs(d.y - c.y) <= 1 AND abs(d.x - c.x) <= 1 GROUP BY ALL)
 {_union({"mean": "mean", "maximum": "maximum", "variety": "CASE WHEN n > 0 THEN variety END"}, "j", ", k AS layer")}""")
def focal_statistics(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return rounded(_labelled({s: R.focal_statistics(c, s) for s in ("mean", "maximum", "variety")}), "v")


@query(f"""WITH {CELLS} SELECT zone, k AS layer, count(v) AS cell_count, round(avg(v), 6) AS mean, min(v) AS minimum, max(v) AS maximum, max(v) - min(v) AS "range", round(stddev_pop(v), 6) AS std, sum(v) AS sum,
 quantile_cont(v, 0.5) AS median, round(quantile_cont(v, 0.9), 6) AS percentile, CAST(count(DISTINCT v) AS DOUBLE) AS variety FROM z JOIN c ON c.y = z.y AND c.x = z.x GROUP BY zone, k""")
def zonal_characterization(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return rounded(R.zonal_characterization(_zones(c), c), "mean", "std", "percentile")


_BINS = "LEAST(9, CAST(floor((v - lo) / (hi - lo) * 10) AS BIGINT))"


@query(f"""WITH {CELLS}, j AS (SELECT zone, v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM z JOIN c ON c.y = z.y AND c.x = z.x WHERE k = 1 AND v IS NOT NULL)
 SELECT zone, {_BINS} AS class, count(*) AS count, 'bins' AS kind FROM j GROUP BY ALL UNION ALL SELECT zone, CAST(round(v / 10) AS BIGINT), count(*), 'classes' FROM j GROUP BY ALL""")
def zonal_histogram(spark, sf_dir):
    c = _cells(spark, sf_dir).where("layer = 1").select("row", "col", "v")
    z = _zones(_cells(spark, sf_dir))
    return _labelled({"bins": R.zonal_histogram(z, c, "bins"), "classes": R.zonal_histogram(z, c.withColumn("v", F.col("v") / 10))})


_EDGES = """e AS (SELECT z.y, z.x, z.zone, 4 - count(o.zone) AS open FROM z LEFT JOIN z o ON o.zone = z.zone AND abs(o.y - z.y) + abs(o.x - z.x) = 1 GROUP BY ALL)"""


@query(f"""WITH {CELLS}, {_EDGES} SELECT zone, count(*) * 4.0::DOUBLE AS area, CAST(sum(open) * 2.0 AS DOUBLE) AS perimeter, round(avg(x + 0.5) * 2, 6) AS centroid_x, round(avg(y + 0.5) * 2, 6) AS centroid_y FROM e GROUP BY zone""")
def zonal_geometry(spark, sf_dir):
    return rounded(R.zonal_geometry(_zones(_cells(spark, sf_dir)), 2.0), "centroid_x", "centroid_y")


@query(f"""WITH {CELLS}, {_EDGES}, m AS (SELECT zone, min(v) AS v FROM e JOIN c ON c.y = e.y AND c.x = e.x AND k = 1 WHERE open > 0 GROUP BY zone) SELECT {AT}, v FROM z JOIN m USING (zone)""")
def zonal_fill(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return R.zonal_fill(_zones(c), c.where("layer = 1").select("row", "col", "v"))


@query(f"""WITH {CELLS}, t AS (SELECT zone AS a, floor(y / 7.0) AS b, CAST(count(*) AS DOUBLE) AS n FROM z GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM t),
 h AS (SELECT sum(-n / t * ln(n / t)) AS hab, sum(-n / t * ln(na / t)) AS ha, sum(-n / t * ln(nb / t)) AS hb FROM s), v AS (SELECT 1 - (hab - hb) / ha AS h, 1 - (hab - ha) / hb AS c FROM h)
 SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v_measure FROM v""")
def spatial_association_between_zones(spark, sf_dir):
    z = _zones(_cells(spark, sf_dir))
    other = z.select("row", "col", F.floor(F.col("row") / 7).alias("zone"))
    return rounded(R.spatial_association_between_zones(z, other), "homogeneity", "completeness", "v_measure")
