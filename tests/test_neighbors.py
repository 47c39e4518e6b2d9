"""Nearest neighbours against brute force, and the fits against numpy."""

import math
import random

import numpy as np
import pytest

from lodestone.operators import neighbors as N
from lodestone.operators import proximity as P
from lodestone.operators import regression as R
from lodestone.operators import zones as Z


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_matches_brute_force_with_a_crowd_copies_and_an_outlier(spark, metric):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(60)] + [(60 + i, rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(30)]
    rows += [(90, 5.0, 5.0), (91, 5.0, 5.0), (92, 5.0, 5.0), (93, 1e5, -1e5), (94, None, 1.0)]
    got = sorted((r.a_id, r["rank"], r.b_id) for r in P.knn(spark.createDataFrame(rows, "fid long, x double, y double"), 3, metric=metric).collect())
    want = []
    for i, x, y in rows[:-1]:
        far = (lambda a, b: math.sqrt((a - x) ** 2 + (b - y) ** 2)) if metric == "euclidean" else (lambda a, b: abs(a - x) + abs(b - y))
        near = sorted((far(a, b), j) for j, a, b in rows[:-1] if j != i)[:3]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(near)]
    assert got == sorted(want)


def test_knn_of_few_and_of_no_points(spark):
    few = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "fid long, x double, y double")
    assert [(r.a_id, r.b_id) for r in P.knn(few, 5).orderBy("a_id").collect()] == [(1, 2), (2, 1)]
    assert P.knn(few.limit(0), 5).count() == 0


def test_outliers_of_coincident_points_are_none(spark):
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(5)], "fid long, x double, y double")
    assert {r.lof for r in N.spatial_outlier_detection(same, 2).collect()} == {1.0}


@pytest.mark.parametrize("family", ["gaussian", "poisson", "logistic"])
def test_regression_solves_the_score_equations(spark, family):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        y = {"gaussian": 1 + 2 * a - b + rng.gauss(0, 0.1), "poisson": float(round(math.exp(0.5 + a))), "logistic": float(rng.random() < 1 / (1 + math.exp(-a)))}[family]
        rows.append((y, a, b))
    out, report, found = R.generalized_linear_regression(spark.createDataFrame([*rows, (None, 1.0, 1.0)], "y double, a double, b double"), "y", ["a", "b"], family)
    x = np.array([[1, a, b] for _, a, b in rows])
    beta = np.array([r.coefficient for r in report.collect()])
    mu = {"gaussian": lambda e: e, "poisson": np.exp, "logistic": lambda e: 1 / (1 + np.exp(-e))}[family](x @ beta)
    assert np.abs(x.T @ (np.array([r[0] for r in rows]) - mu)).max() < 1e-6
    assert found["observations"] == 200 and out.where("glr_estimated IS NULL").count() == 1
    assert all(0 <= r.probability <= 1 for r in report.collect())


def test_affine_links_without_error_and_student_p(spark):
    links = spark.createDataFrame([(float(x), float(y), 2.0 * x - y + 5, x + 3.0 * y - 1) for x in range(3) for y in range(3)], "x double, y double, to_x double, to_y double")
    assert R.calculate_transformation_errors(links)[1]["rmse"] < 1e-9
    assert R._student(2.228, 10) == pytest.approx(0.05, abs=1e-4) and R._student(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)


def test_points_in_a_polygon_that_spans_many_cells(spark):
    ring = [(0.0, 0.0), (100.0, 0.0), (50.0, 80.0)]
    zones = spark.createDataFrame([(1, ring), (2, [(200.0, 0.0), (201.0, 0.0), (200.5, 1.0)]), (3, [(0.0, 0.0)])], "zone long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 50.0, 10.0), (2, 5.0, 40.0), (3, 200.5, 0.5), (4, None, 1.0)], "fid long, x double, y double")
    assert sorted((r.fid, r.zone) for r in Z.points_in_polygons(points, zones, "zone").collect()) == [(1, 1), (3, 2)]
