"""Attribute and table operators: grouping, reshaping, ordering, classing, scaling, ranking."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number, global_running_sum

STATISTICS = ("count", "sum", "mean", "min", "max", "std", "first", "last")


def finite(c: str) -> Column:
    """The column as double where it is a finite number, else null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def summary_statistics(df: DataFrame, statistics: list[tuple[str, str]], case_fields: list[str] = (), row_id: str | None = None) -> DataFrame:
    """One row per group: the record count and ``<field>_<statistic>`` columns. Numbers that are
    not finite are passed over; first and last are those of the non-null values by ``row_id``. An empty input gives no rows."""
    out = []
    for field, stat in statistics:
        if stat not in STATISTICS:
            raise ValueError(f"unknown statistic {stat!r}")
        x = finite(field) if stat in ("sum", "mean", "min", "max", "std") else F.col(field)
        if stat in ("first", "last"):
            if row_id is None:
                raise ValueError(f"{stat} needs row_id")
            c = (F.min_by if stat == "first" else F.max_by)(field, F.when(F.col(field).isNotNull(), F.col(row_id)))
        else:
            c = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}[stat](x)
        out.append(c.alias(f"{field}_{stat}"))
    return df.groupBy(*case_fields).agg(F.count("*").alias("count"), *out).where("count > 0")


def _label(df: DataFrame, c: str) -> Column:
    """The text of a pivot value; whole floats print as integers, texts stay as they are."""
    text = F.col(c).cast("string")
    return F.coalesce(F.regexp_replace(text, r"\.0$", "") if dict(df.dtypes)[c] in ("float", "double") else text, F.lit("NULL"))


def pivot_table(df: DataFrame, fields: list[str], pivot_field: str, value_field: str, row_id: str, aggregate: str = "first", limit: int = 512) -> DataFrame:
    """Long to wide, columns in first-seen order by ``row_id`` with names of letters, digits and _."""
    seen = [r["_p"] for r in df.groupBy(_label(df, pivot_field).alias("_p")).agg(F.min(row_id).alias("o")).orderBy("o").limit(limit + 1).collect()]
    if len(seen) > limit:
        raise ValueError(f"more than {limit} columns")
    v = {
        "first": F.min_by(value_field, row_id), "sum": F.sum(finite(value_field)), "mean": F.avg(finite(value_field)),
        "min": F.min(finite(value_field)), "max": F.max(finite(value_field)), "count": F.count(value_field),
    }[aggregate]
    out = df.withColumn("_p", _label(df, pivot_field)).groupBy(*fields).pivot("_p", seen).agg(v)
    names: list[str] = list(fields)
    for s in seen:
        base = re.sub(r"[^A-Za-z0-9_]", "_", s)
        base = f"_{base}" if base[:1].isdigit() else base
        name, k = base, 1
        while name in names:
            name, k = f"{base}_{k}", k + 1
        names.append(name)
    out = out.toDF(*names)
    return out.fillna(0, names[len(fields) :]) if aggregate == "count" else out


def transpose_fields(df: DataFrame, columns: list[str], retain: list[str] = (), drop_nulls: bool = False, labels: dict[str, str] | None = None, row_id: str | None = None) -> DataFrame:
    """Wide to long: a row per input row and column, with FIELD (its label, if it has one) and VALUE, and
    with ``row_id`` the 0-based row in that order as SRC_FID."""
    if row_id is not None:
        numbered = global_row_number(df, [F.col(row_id)], "SRC_FID").withColumn("SRC_FID", F.col("SRC_FID") - 1)
        return transpose_fields(numbered, columns, [*retain, "SRC_FID"], drop_nulls, labels)
    if labels:
        names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
        out = transpose_fields(df, columns, retain, drop_nulls)
        return out.withColumn("FIELD", F.coalesce(names[F.col("FIELD")], F.col("FIELD")))
    types = {dict(df.dtypes)[c] for c in columns}
    whole = {"tinyint", "smallint", "int", "bigint"}
    kind = "bigint" if types <= whole else "double" if types <= whole | {"float", "double"} else "string"
    out = df.select(*retain, *(F.col(c).cast(kind) for c in columns)).unpivot(list(retain), columns, "FIELD", "VALUE")
    return out.where("VALUE IS NOT NULL") if drop_nulls else out


def sort_features(df: DataFrame, fields: list[tuple[str, bool]], row_id: str, index_field: str | None = None) -> DataFrame:
    """Ordered rows: nulls first ascending, last descending; ties by ``row_id``."""
    order = [F.col(f).asc_nulls_first() if up else F.col(f).desc_nulls_last() for f, up in fields] + [F.col(row_id)]
    return global_row_number(df, order, index_field) if index_field else df.orderBy(*order)


def find_identical(df: DataFrame, fields: list[str], row_id: str, mode: str = "report") -> DataFrame:
    """dup_group (0-based, by first row) and dup_seq within it, or only the first rows."""
    ranked = df.withColumn("dup_seq", F.row_number().over(Window.partitionBy(*fields).orderBy(row_id)).cast("long") - 1)
    ranked = ranked.withColumn("_first", F.min(row_id).over(Window.partitionBy(*fields)))
    if mode == "delete":
        return ranked.where("dup_seq = 0").drop("dup_seq", "_first")
    groups = global_row_number(ranked.where("dup_seq = 0").select("_first"), [F.col("_first")], "dup_group")
    return ranked.join(groups, "_first").withColumn("dup_group", F.col("dup_group") - 1).drop("_first")


def _fit(df: DataFrame, x: Column) -> dict:
    return df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n")).first().asDict()


def _quantiles(df: DataFrame, x: Column, at: list[float]) -> list[float]:
    return df.agg(F.percentile(x, at)).first()[0] or []


def breaks(df: DataFrame, field: str, method: str, classes: int = 5, interval: float = 1.0, std_dev_interval: float = 1.0) -> list[float]:
    """Inner class breaks of a numeric column."""
    x, f = finite(field), _fit(df, finite(field))
    if not f["n"] or f["lo"] == f["hi"]:
        return []
    lo, hi = f["lo"], f["hi"]
    if method == "equal_interval":
        return [lo + (hi - lo) * k / classes for k in range(1, classes)]
    if method == "defined_interval":
        return [lo + interval * k for k in range(1, int((hi - lo) / interval) + 1) if lo + interval * k < hi]
    if method == "quantile":
        return _quantiles(df, x, [k / classes for k in range(1, classes)])
    if method == "geometric_interval":
        shift = 1 - lo if lo <= 0 else 0.0
        ratio = ((hi + shift) / (lo + shift)) ** (1 / classes)
        return [(lo + shift) * ratio**k - shift for k in range(1, classes)]
    if method == "std_dev":
        step = f["sd"] * std_dev_interval
        k0, k1 = int((lo - f["m"]) / step) - 1, int((hi - f["m"]) / step) + 1
        return [b for k in range(k0, k1 + 1) if lo < (b := f["m"] + k * step) < hi]
    raise ValueError(f"unknown method {method!r}")


def reclassify_field(df: DataFrame, field: str, method: str = "equal_interval", class_field: str = "class", **options) -> DataFrame:
    """Class 1 plus the number of breaks below the value."""
    cuts = breaks(df, field, method, **options)
    x = finite(field)
    above = reduce(lambda a, b: a + b, [F.when(x > c, 1).otherwise(0) for c in cuts], F.lit(1))
    return df.withColumn(class_field, F.when(x.isNotNull(), above).cast("long"))


#: Suffix of each transform.
SUFFIX = {"zscore": "_z", "minmax": "_minmax", "robust": "_robust", "log": "_log", "log1p": "_log1p", "sqrt": "_sqrt", "inverse": "_inv", "boxcox": "_boxcox", "bin": "_bin"}


def _fits(df: DataFrame, fields: list[str], quantiles: list[float] = ()) -> dict[str, dict]:
    """Extremes, mean, sample deviation, count and quantiles of every field, in one aggregate."""
    made = []
    for c in fields:
        x = finite(c)
        at = F.percentile(x, F.array(*(F.lit(q) for q in quantiles))) if quantiles else F.lit(None)
        made.append(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"), at.alias("q")).alias(c))
    row = df.agg(*made).first()
    return {c: row[c].asDict() for c in fields}


def boxcox_lambda(df: DataFrame, field: str, steps: int = 60) -> float:
    """The Box-Cox parameter of greatest likelihood on [-5, 5], by golden section; each step is one aggregate."""
    x = F.when(finite(field) > 0, finite(field))
    base = df.agg(F.sum(F.log(x)).alias("logs"), F.count(x).alias("n")).first()
    if not base["n"]:
        return 1.0

    def likelihood(lam: float) -> float:
        y = F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam
        spread = df.agg(F.var_pop(y)).first()[0]
        return -math.inf if not spread or math.isnan(spread) else (lam - 1) * base["logs"] - base["n"] / 2 * math.log(spread)

    ratio, lo, hi = (math.sqrt(5) - 1) / 2, -5.0, 5.0
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = likelihood(a), likelihood(b)
    for _ in range(steps):
        if fa < fb:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = likelihood(b)
        else:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = likelihood(a)
    return (lo + hi) / 2


def transform_fields(df: DataFrame, fields: list[str], transform: str, bins: int = 5, bin_method: str = "equal_interval", boxcox: float | None = None, limit: int = 50) -> DataFrame:
    """A scaled, transformed, binned or one-hot encoded column per field; no spread gives 0, values out of
    domain null. Bins count from 1; one-hot columns stand in the order of the categories."""
    if transform == "onehot":
        for field in fields:
            seen = [r[0] for r in df.select(field).where(F.col(field).isNotNull()).distinct().orderBy(field).limit(limit + 1).collect()]
            if len(seen) > limit:
                raise ValueError(f"more than {limit} categories")
            df = df.withColumns({f"{field}_{re.sub('[^A-Za-z0-9_]', '_', str(v))}": F.coalesce((F.col(field) == F.lit(v)).cast("long"), F.lit(0).cast("long")) for v in seen})
        return df
    inner = [k / bins for k in range(1, bins)]
    quantiles = [0.25, 0.5, 0.75] if transform == "robust" else inner if transform == "bin" and bin_method == "quantile" else []
    fits = _fits(df, fields, quantiles) if transform in ("zscore", "minmax", "robust", "bin") else {}
    for field in fields:
        x, f = finite(field), fits.get(field)
        if transform in ("zscore", "minmax", "robust"):
            centre, spread = (f["m"], f["sd"]) if transform == "zscore" else (f["lo"], (f["hi"] or 0) - (f["lo"] or 0))
            if transform == "robust" and f["n"]:
                q1, centre, q3 = f["q"]
                spread = q3 - q1
            y = (x - F.lit(centre)) / F.lit(spread) if spread else F.when(x.isNotNull(), F.lit(0.0))
        elif transform == "bin":
            if bins < 2:
                raise ValueError("at least 2 bins")
            if not f["n"]:
                cuts = []
            elif bin_method == "std_dev":
                cuts = [f["m"] + (f["sd"] or 0.0) * (k - bins / 2) for k in range(1, bins)]
            else:
                cuts = f["q"] if bin_method == "quantile" else [f["lo"] + (f["hi"] - f["lo"]) * q for q in inner]
            y = F.when(x.isNotNull(), reduce(lambda a, b: a + b, [F.when(x > c, 1).otherwise(0) for c in cuts], F.lit(1))).cast("long")
        elif transform == "boxcox":
            lam = boxcox_lambda(df, field) if boxcox is None else boxcox
            y = F.when(x > 0, F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam)
        else:
            y = {"log": F.when(x > 0, F.log(x)), "log1p": F.when(x > -1, F.log1p(x)), "sqrt": F.when(x >= 0, F.sqrt(x)), "inverse": F.when(x != 0, 1 / x)}[transform]
        df = df.withColumn(field + SUFFIX[transform], y)
    return df


def calculate_composite_index(df: DataFrame, fields: list[str], row_id: str, weights: list[float] | None = None, scaling: str = "minmax", combine: str = "mean", output_range: str = "none") -> DataFrame:
    """Scaled columns, their combination, and its rank and percentile. Missing values count as 0.5 (or 0
    for z-scores and unscaled ones), and so does a column of one value under min-max."""
    weights = weights or [1.0] * len(fields)
    fits = _fits(df, fields)
    missing = 0.5 if scaling in ("minmax", "percentile") else 0.0
    if scaling == "percentile":
        for c in fields:
            # Rank among the values, counted by distinct value; equal values share the greatest rank.
            counts = df.where(finite(c).isNotNull()).groupBy(finite(c).alias("_x")).agg(F.count("*").alias("_n"))
            below = global_running_sum(counts, [F.col("_x")], "_n", "_below").select("_x", "_below")
            df = df.join(below, finite(c) == F.col("_x"), "left").withColumn(f"{c}_scaled", (F.col("_below") - 1) / max(fits[c]["n"] - 1, 1)).drop("_x", "_below")
    for c in fields:
        x, f = finite(c), fits[c]
        if scaling == "minmax":
            part = (x - F.lit(f["lo"])) / F.lit(f["hi"] - f["lo"]) if f["n"] and f["hi"] > f["lo"] else F.lit(0.5)
        elif scaling == "zscore":
            part = (x - F.lit(f["m"])) / F.lit(f["sd"]) if f["sd"] else F.lit(0.0)
        elif scaling == "percentile":
            part = F.col(f"{c}_scaled")
        else:
            part = x
        df = df.withColumn(f"{c}_scaled", F.coalesce(part, F.lit(missing)))
    parts = [F.col(f"{c}_scaled") for c in fields]
    if combine == "geometric_mean":
        total = F.exp(reduce(lambda a, b: a + b, [F.log(F.greatest(p, F.lit(1e-9))) * w for p, w in zip(parts, weights)]) / sum(weights))
    else:
        total = reduce(lambda a, b: a + b, [p * w for p, w in zip(parts, weights)])
        total = total / sum(weights) if combine == "mean" else total
    scaled = df.withColumn("index", total)
    if output_range != "none":
        f = _fits(scaled, ["index"])["index"]
        span = (f["hi"] or 0.0) - (f["lo"] or 0.0)
        if output_range == "zscore":
            y = (F.col("index") - F.lit(f["m"])) / F.lit(f["sd"]) if f["sd"] else F.lit(0.0)
        else:
            y = (F.col("index") - F.lit(f["lo"])) / F.lit(span) if span else F.lit(0.5)
            y = y * 100 if output_range == "zero_to_100" else y
        scaled = scaled.withColumn("index", y)
    n = scaled.count()
    out = global_row_number(scaled, [F.col("index").desc(), F.col(row_id)], "index_rank")
    return out.withColumn("index_pctl", 100.0 * (1 - (F.col("index_rank") - 1) / max(n - 1, 1)))


def calculate_rates(df: DataFrame, count_field: str, population_field: str, per: float = 1.0) -> DataFrame:
    """Crude and global empirical-Bayes rates with their standard error."""
    o, p = F.col(count_field).cast("double"), F.col(population_field).cast("double")
    s = df.where(p > 0).agg(F.sum(o).alias("o"), F.sum(p).alias("p"), F.count("*").alias("n")).first()
    m = s["o"] / s["p"] if s["p"] else 0.0
    crude = F.when(p > 0, o / p).otherwise(0.0)
    s2 = df.where(p > 0).agg(F.sum(p * (crude - m) ** 2) / s["p"]).first()[0] if s["p"] else 0.0
    a = max(s2 - m / (s["p"] / s["n"]), 0.0) if s["p"] else 0.0
    w = a / (a + m / p) if m > 0 else F.lit(0.0)
    smooth = F.when(p > 0, w * crude + (1 - w) * m).otherwise(m)
    return df.withColumn("crude_rate", crude * per).withColumn("smooth_rate", smooth * per).withColumn("rate_se", F.when(p > 0, F.sqrt(o) / p).otherwise(0.0) * per)


def calculate_end_time(df: DataFrame, start: str, ids: list[str], row_id: str, last_record: str = "null", duration: float = 0.0) -> DataFrame:
    """end_time: the next start of the entity; rows without a start have none."""
    w = Window.partitionBy(*ids, F.col(start).isNull()).orderBy(start, row_id)
    last = {"null": F.lit(None), "same_as_start": F.col(start), "duration": F.col(start) + duration}[last_record]
    return df.withColumn("end_time", F.when(F.col(start).isNotNull(), F.coalesce(F.lead(start).over(w), last)))


def estimate_time_to_event(df: DataFrame, age: str, event: str, stratum: str) -> DataFrame:
    """Kaplan-Meier survival at each distinct event time of each stratum."""
    rows = df.where(finite(age).isNotNull() & (F.col(age) >= 0)).select(
        F.coalesce(F.col(stratum).cast("string"), F.lit("<null>")).alias("km_stratum"), finite(age).alias("t"), (F.col(event).cast("double") >= 0.5).cast("int").alias("e")
    )
    at = rows.groupBy("km_stratum", "t").agg(F.count("*").alias("n"), F.sum("e").alias("d"))
    later = Window.partitionBy("km_stratum").orderBy("t")
    at = at.withColumn("risk", F.sum("n").over(later.rowsBetween(0, Window.unboundedFollowing))).where("d > 0")
    log = F.when(F.col("d") < F.col("risk"), F.log(1 - F.col("d") / F.col("risk")))
    gone = F.max((F.col("d") >= F.col("risk")).cast("int")).over(later) == 1
    return at.withColumn("km_survival", F.when(gone, 0.0).otherwise(F.exp(F.sum(log).over(later)))).select("km_stratum", "t", "risk", "d", "km_survival")


def similarity_search(reference: DataFrame, candidates: DataFrame, fields: list[str], row_id: str, num_results: int = 10, method: str = "euclidean", which: str = "most") -> DataFrame:
    """The candidates most or least like the reference profile, ranked by standardised distance or by cosine,
    with the standardised columns ``<field>_zd``; with ``both`` the most alike come first, each part with its match."""
    both = reference.select(*fields).unionByName(candidates.select(*fields))
    stats = both.agg(*(F.struct(F.avg(finite(c)).alias("m"), F.stddev_pop(finite(c)).alias("s")).alias(c) for c in fields)).first()

    def z(c: str) -> Column:
        return (finite(c) - stats[c]["m"]) / max(stats[c]["s"] or 0, 1e-12)

    goal = reference.agg(*(F.avg(z(c)).alias(c) for c in fields)).first()
    scored = candidates.withColumns({f"{c}_zd": z(c) for c in fields})
    total = lambda parts: reduce(lambda a, b: a + b, list(parts))
    if method == "cosine":
        dot, own = total(F.col(f"{c}_zd") * goal[c] for c in fields), total(F.col(f"{c}_zd") * F.col(f"{c}_zd") for c in fields)
        norm = math.sqrt(sum(goal[c] ** 2 for c in fields))
        scored = scored.withColumn("sim_score", F.when((own > 0) & F.lit(norm > 0), dot / (F.sqrt(own) * norm)).otherwise(0.0 * dot))
        nearness = F.col("sim_score").desc()
    else:
        scored = scored.withColumn("sim_score", F.sqrt(total(F.pow(F.col(f"{c}_zd") - goal[c], F.lit(2.0)) for c in fields)))
        nearness = F.col("sim_score").asc()
    scored = scored.where("sim_score IS NOT NULL")
    parts = []
    for part in ("most", "least") if which == "both" else (which,):
        order = [nearness if part == "most" else (F.col("sim_score").asc() if method == "cosine" else F.col("sim_score").desc()), F.col(row_id)]
        # At most num_results rows.
        top = scored.orderBy(*order).limit(num_results)
        parts.append(top.withColumn("sim_rank", F.row_number().over(Window.orderBy(*order)).cast("long")).withColumn("match", F.lit(part)))
    return reduce(DataFrame.unionByName, parts)


def subset_features(df: DataFrame, row_id: str, size: float, size_method: str = "percentage", seed: int = 0, group_field: str | None = None) -> DataFrame:
    """``training``: whether a row is among the exact number drawn, of each group or of all; rows are drawn in
    the order of a seeded hash of row_id, so reruns agree. Groups are numbered by one window of narrow keys."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    group = F.lit(1) if group_field is None else F.col(group_field)
    keyed = df.withColumn("_g", group).withColumn("_key", key)
    if group_field is None:
        n = keyed.count()
        take = min(n, math.floor(size / 100 * n + 0.5) if size_method == "percentage" else int(size))
        ranked = global_row_number(keyed, [F.col("_key"), F.col(row_id)], "_rank")
        return ranked.withColumn("training", F.col("_rank") <= take).drop("_g", "_key", "_rank")
    w = Window.partitionBy("_g")
    take = F.floor(F.lit(size / 100) * F.count("*").over(w) + 0.5) if size_method == "percentage" else F.lit(int(size))
    ranked = keyed.withColumn("_take", take).withColumn("_rank", F.row_number().over(w.orderBy("_key", row_id)))
    return ranked.withColumn("training", F.col("_rank") <= F.col("_take")).drop("_g", "_key", "_rank", "_take")


def eighty_twenty_analysis(df: DataFrame, x: str, y: str, weight: str | None = None, threshold: float = 80.0, tolerance: float = 1e-8) -> DataFrame:
    """Pareto concentration: a row per location (points that round to one cell of ``tolerance``), by falling
    count, with its rank, running share in per cent and band; the head includes the row that crosses the threshold."""
    cell = df.groupBy(F.round(F.col(x) / tolerance).alias("_kx"), F.round(F.col(y) / tolerance).alias("_ky"))
    spots = cell.agg(F.min(x).alias("x"), F.min(y).alias("y"), F.sum(F.lit(1.0) if weight is None else finite(weight)).alias("incident_count")).drop("_kx", "_ky")
    order = [F.col("incident_count").desc(), F.col("x"), F.col("y")]
    ranked = global_running_sum(spots, order, "incident_count", "_run", rank="rank")
    total = spots.agg(F.sum("incident_count")).first()[0] or 0.0
    share = 100.0 * F.col("_run") / total if total else F.lit(0.0)
    before = 100.0 * (F.col("_run") - F.col("incident_count")) / total if total else F.lit(0.0)
    return ranked.select(
        (F.col("rank") - 1).alias("location_id"), "x", "y", "incident_count", "rank", share.alias("cumulative_pct"),
        F.when(before < threshold, "head").otherwise("tail").alias("band"),
    )


def hot_spot_analysis_comparison(first: DataFrame, second: DataFrame, bin_field: str, match_field: str, significance: float = 0.0) -> DataFrame:
    """Per matched feature its category in both layers, the transition and whether they agree."""

    def category(c: str) -> Column:
        x = finite(c)
        return F.when(x.isNull() | (F.abs(x) <= significance), "none").when(x > 0, "hot").otherwise("cold")

    a = first.where(F.col(match_field).isNotNull()).select(match_field, F.col(bin_field).alias("bin1"))
    b = second.select(match_field, F.col(bin_field).alias("bin2"))
    both = a.join(b, match_field).withColumn("cat1", category("bin1")).withColumn("cat2", category("bin2"))
    return both.withColumn("category", F.concat_ws("_to_", "cat1", "cat2")).withColumn("agreement", (F.col("cat1") == F.col("cat2")).cast("long"))


def pairwise_comparison_weights(matrix: list[list[float]]) -> tuple[list[float], float]:
    """The weights of a reciprocal comparison matrix, its principal eigenvector, and the consistency ratio."""
    n = len(matrix)
    w = [1.0 / n] * n
    for _ in range(200):
        v = [sum(a * x for a, x in zip(row, w)) for row in matrix]
        total = sum(v)
        v, w = [x / total for x in v], w
        done, w = max(abs(a - b) for a, b in zip(v, w)) < 1e-14, v
        if done:
            break
    top = sum(sum(a * x for a, x in zip(row, w)) / y for row, y in zip(matrix, w)) / n
    #: The random consistency indices of matrices of 1 to 10 criteria.
    random = [0.0, 0.0, 0.58, 0.90, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49]
    expected = random[min(n, 10) - 1]
    return w, ((top - n) / (n - 1) / expected if n > 2 else 0.0)


def split_by_attributes(df: DataFrame, fields: list[str], folder: str, format: str = "parquet") -> None:
    """Writes one folder of files per combination of keys; rows go to the writers by key and a salt."""
    df.repartition(*fields, F.floor(F.rand(7) * 8)).write.partitionBy(*fields).format(format).mode("errorifexists").save(folder)
