"""Regression, components and fitted transforms: the sums of products come from one aggregate per pass, and only these small
matrices are solved on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .table import finite


def _products(df: DataFrame, terms: list[Column], weight: Column, response: Column) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of the products of terms, and of terms with the response."""
    p = len(terms)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    made = [F.sum(weight * terms[i] * terms[j]) for i, j in pairs] + [F.sum(weight * t * response) for t in terms]
    row = [v or 0.0 for v in df.agg(*(c.alias(f"s{k}") for k, c in enumerate(made))).first()]
    a = np.zeros((p, p))
    for (i, j), v in zip(pairs, row):
        a[i, j] = a[j, i] = v
    return a, np.array(row[len(pairs) :])


def _student(t: float, df: float) -> float:
    """The two-sided p of Student's t: with t = sqrt(df) tan(a) the density is cos(a) ** (df - 1), integrated by Simpson's rule."""
    start, end = math.atan(t / math.sqrt(df)), min(math.pi / 2, 40 / math.sqrt(df))
    if start >= end:
        return 0.0

    def area(a: float, b: float) -> float:
        x = np.linspace(a, b, 4001)
        y = np.exp((df - 1) * np.log(np.maximum(np.cos(x), 1e-300)))
        return float((b - a) / 12000 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))

    return min(1.0, area(start, end) / area(0.0, end))


def generalized_linear_regression(df: DataFrame, dependent: str, explanatory: list[str], family: str = "gaussian", passes: int = 50) -> tuple[DataFrame, DataFrame, dict]:
    """Rows with glr_estimated, glr_residual and glr_std_resid (null where a value is missing); a table of terms with
    coefficient, std_error, statistic, probability and vif; and the diagnostics of the fit.

    Gaussian models take one pass, Poisson and logistic ones reweighted passes until the coefficients settle."""
    if family not in ("gaussian", "poisson", "logistic"):
        raise ValueError(f"unknown family {family!r}")
    y, terms = finite(dependent), [F.lit(1.0), *(finite(x) for x in explanatory)]
    known = y.isNotNull()
    for t in terms[1:]:
        known = known & t.isNotNull()
    used, p = df.where(known), len(terms)
    plain, toward = _products(used, terms, F.lit(1.0), y)
    n = int(plain[0, 0])
    if n <= p:
        raise ValueError("more terms than observations")

    def linear(beta: np.ndarray) -> Column:
        return sum((float(b) * t for b, t in zip(beta, terms)), F.lit(0.0))

    def mean(eta: Column) -> Column:
        return {"gaussian": eta, "poisson": F.exp(eta), "logistic": 1.0 / (1.0 + F.exp(-eta))}[family]

    def variance(mu: Column) -> Column:
        return {"gaussian": F.lit(1.0), "poisson": mu, "logistic": mu * (1.0 - mu)}[family]

    try:
        if family == "gaussian":
            weighted, beta = plain, np.linalg.solve(plain, toward)
        else:
            beta, mu = np.zeros(p), F.greatest(y + 0.1, F.lit(1e-3)) if family == "poisson" else (y + 0.5) / 2.0
            eta = F.log(mu) if family == "poisson" else F.log(mu / (1.0 - mu))
            for _ in range(passes):
                v = F.greatest(variance(mu), F.lit(1e-12))
                weighted, right = _products(used, terms, v, eta + (y - mu) / v)
                before, beta = beta, np.linalg.solve(weighted, right)
                if np.abs(beta - before).sum() < 1e-10:
                    break
                eta = linear(beta)
                mu = mean(eta)
        inverse = np.linalg.inv(weighted)
    except np.linalg.LinAlgError as e:
        raise ValueError("the explanatory fields are collinear or constant") from e

    mu = mean(linear(beta))
    rest = y - mu
    out = df.withColumns({"glr_estimated": F.when(known, mu), "glr_residual": F.when(known, rest), "glr_std_resid": F.when(known, F.try_divide(rest, F.sqrt(variance(mu))))})
    middle = toward[0] / n
    safe = F.least(F.greatest(mu, F.lit(1e-12)), F.lit(1 - 1e-12))
    gap = {
        "gaussian": lambda m: (y - m) * (y - m),
        "poisson": lambda m: 2.0 * (F.when(y > 0, y * F.log(F.greatest(y, F.lit(1e-12)) / m)).otherwise(0.0) - (y - m)),
        "logistic": lambda m: -2.0 * (y * F.log(m) + (1.0 - y) * F.log(1.0 - m)),
    }[family]
    fitted = {"gaussian": mu, "poisson": F.greatest(mu, F.lit(1e-12)), "logistic": safe}[family]
    sums = used.agg(F.sum(rest * rest).alias("rss"), F.sum(gap(fitted)).alias("dev"), F.sum(gap(F.lit(middle))).alias("null")).first()
    spread = sums["rss"] / max(n - p, 1) if family == "gaussian" else 1.0
    about = plain[1:, 1:] - np.outer(plain[0, 1:], plain[0, 1:]) / n
    scale = np.sqrt(np.diag(about))
    vif = [None, *np.diag(np.linalg.inv(about / np.outer(scale, scale))).tolist()] if p > 1 else [None]
    rows = []
    for k, name in enumerate(["Intercept", *explanatory]):
        error = math.sqrt(max(inverse[k, k] * spread, 0.0))
        stat = float(beta[k]) / error if error else None
        chance = None if stat is None else _student(abs(stat), max(n - p, 1)) if family == "gaussian" else math.erfc(abs(stat) / math.sqrt(2))
        rows.append((name, float(beta[k]), error, stat, chance, vif[k]))
    report = df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, statistic double, probability double, vif double")
    found = {"observations": n, "residual_ss": sums["rss"], "deviance": sums["dev"], "null_deviance": sums["null"]}
    share = 1 - sums["dev"] / sums["null"] if sums["null"] else 0.0
    if family == "gaussian":
        likelihood = -0.5 * n * (math.log(2 * math.pi) + math.log(sums["rss"] / n) + 1) if sums["rss"] else None
        found |= {"r2": share, "adjusted_r2": 1 - (1 - share) * (n - 1) / max(n - p, 1), "log_likelihood": likelihood}
    else:
        found |= {"pseudo_r2": share} | ({"log_likelihood": -sums["dev"] / 2} if family == "logistic" else {})
    if found.get("log_likelihood") is not None:
        k = p + (family == "gaussian")
        found["aic"] = -2 * found["log_likelihood"] + 2 * k
        found["aicc"] = found["aic"] + 2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.inf
    return out, report, found


def dimension_reduction(df: DataFrame, fields: list[str], components: int, standardize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows with the scores PC1, PC2, ... of their fields, missing values as the mean; and a table of components with eigenvalue,
    share of variance and its running sum. The largest loading of a component, the last of several, is positive."""
    f = df.agg(*(F.struct(F.avg(finite(c)).alias("m"), F.stddev_samp(finite(c)).alias("s")).alias(c) for c in fields)).first()
    z = [(F.coalesce(finite(c), F.lit(f[c]["m"])) - F.lit(f[c]["m"])) / F.lit((f[c]["s"] or 1.0) if standardize else 1.0) for c in fields]
    p = len(fields)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(*(F.covar_samp(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((p, p))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(cov)
    rows, total, run = [], max(float(values.sum()), 1e-300), 0.0
    out = df
    for k, at in enumerate(np.argsort(-values, kind="stable")[:components]):
        v = vectors[:, at]
        size = np.round(np.abs(v), 12)
        v = v * (1 if v[p - 1 - int(np.argmax(size[::-1]))] >= 0 else -1)
        out = out.withColumn(f"PC{k + 1}", sum((float(a) * c for a, c in zip(v, z)), F.lit(0.0)))
        share = float(values[at]) / total
        run += share
        rows.append((k + 1, float(values[at]), share, run))
    return out, df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, variance_explained double, cumulative_explained double")


def calculate_transformation_errors(links: DataFrame, method: str = "affine") -> tuple[DataFrame, dict]:
    """Links (x, y, to_x, to_y) with the residuals RESIDUAL_X, RESIDUAL_Y and RESIDUAL of the fitted transform and each one's
    share of their squares (null for links that lack a coordinate); and the error of the whole."""
    x, y, u, v = (finite(c) for c in ("x", "y", "to_x", "to_y"))
    known = x.isNotNull() & y.isNotNull() & u.isNotNull() & v.isNotNull()
    used = links.where(known)
    c = used.agg(F.avg(x), F.avg(y), F.avg(u), F.avg(v), F.count("*")).first()
    least = {"affine": 3, "similarity": 2}[method]
    if c[4] < least:
        raise ValueError(f"{method} needs {least} links")
    # About the means, so that large coordinates lose no digits.
    dx, dy, du, dv = x - c[0], y - c[1], u - c[2], v - c[3]
    if method == "affine":
        a, right = _products(used, [dx, dy], F.lit(1.0), du)
        other = _products(used, [dx, dy], F.lit(1.0), dv)[1]
        try:
            (a11, a12), (a21, a22) = np.linalg.solve(a, right), np.linalg.solve(a, other)
        except np.linalg.LinAlgError as e:
            raise ValueError("the links lie on one line") from e
    else:
        s = used.agg(F.sum(dx * dx + dy * dy), F.sum(dx * du + dy * dv), F.sum(dx * dv - dy * du)).first()
        if not s[0]:
            raise ValueError("the links share one point")
        a11, a21 = s[1] / s[0], s[2] / s[0]
        a12, a22 = -a21, a11
    rx, ry = float(a11) * dx + float(a12) * dy - du, float(a21) * dx + float(a22) * dy - dv
    total = used.agg(F.sum(rx * rx + ry * ry)).first()[0] or 0.0
    share = (rx * rx + ry * ry) / total if total else F.lit(0.0)
    out = links.withColumns({k: F.when(known, e) for k, e in (("RESIDUAL_X", rx), ("RESIDUAL_Y", ry), ("RESIDUAL", F.sqrt(rx * rx + ry * ry)), ("ERR_SHARE", share))})
    return out, {"rmse": math.sqrt(total / c[4]), "link_count": c[4]}
