"""Statistics over distance bands and nearest neighbours without tables of pairs, against brute force."""

import math
import random

import numpy as np
import pytest

from lodestone.operators import neighbors as N
from lodestone.operators import proximity as P

BAND = 12.0


@pytest.fixture
def no_pairs(monkeypatch):
    def fail(*args, **kwargs):
        raise AssertionError("made a table of pairs")

    monkeypatch.setattr(P, "pairs_within", fail)
    monkeypatch.setattr(N, "pairs_within", fail, raising=False)


def crowd(n=240, seed=11):
    """Points, half of them on whole coordinates, some at one place, with values."""
    rng = random.Random(seed)
    rows = [(i, float(rng.randrange(40)), float(rng.randrange(40)), float(rng.randrange(1, 50))) for i in range(n // 2)]
    rows += [(i, rng.uniform(-3, 60), rng.uniform(-3, 60), rng.uniform(1, 9)) for i in range(n // 2, n - 8)]
    return rows + [(i, 7.0, 7.0, float(i % 5 + 1)) for i in range(n - 8, n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "fid long, x double, y double, v double")


def far(rows):
    x, y = (np.array([r[c] for r in rows]) for c in (1, 2))
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    np.fill_diagonal(d, np.inf)
    return d


def nearest(own, rows):
    return {i: sorted((math.sqrt((r[1] - x) ** 2 + (r[2] - y) ** 2), r[0]) for r in rows) for i, x, y, _ in own}


def moments(w, v):
    both, z = w + w.T, v - v.mean()
    s0, s1, s2 = w.sum(), (both**2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    return s0, s1, s2, z @ w @ z


@pytest.mark.usefixtures("no_pairs")
def test_hot_spots_without_pairs(spark):
    rows = crowd()
    got = {r.fid: r.GiZScore for r in N.hot_spots(frame(spark, [*rows, (999, None, 1.0, 5.0)]), "v", BAND).collect()}
    v, near = np.array([r[3] for r in rows]), (far(rows) <= BAND) + np.eye(len(rows))
    n, w = len(rows), near.sum(1)
    z = (near @ v - v.mean() * w) / (v.std() * np.sqrt((n * w - w * w) / (n - 1)))
    assert [got[r[0]] for r in rows] == pytest.approx(list(z)) and len(got) == n


@pytest.mark.usefixtures("no_pairs")
@pytest.mark.parametrize("standardize", [True, False])
@pytest.mark.parametrize("method,exponent", [("fixed_distance_band", 1.0), ("inverse_distance", 1.0), ("inverse_distance", 2.0)])
def test_moran_under_distance_bands_without_pairs(spark, method, exponent, standardize):
    rows = crowd()
    options = {"method": method, "threshold": BAND, "exponent": exponent, "standardize": standardize}
    got = N.compare_spatial_weights(frame(spark, rows), ["v"], {"m": options}).first()
    d, v, n = far(rows), np.array([r[3] for r in rows]), len(rows)
    w = np.where(d <= BAND, 1.0, 0.0)
    if method == "inverse_distance":
        w = np.where((d <= BAND) & (d > 0), 1 / np.maximum(d, 1e-9) ** exponent, 0.0)
    links = (w > 0).sum()
    if standardize:
        w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    s0, s1, s2, cross = moments(w, v)
    i, expected = n / s0 * cross / (v.var() * n), -1 / (n - 1)
    variance = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - expected**2
    assert (got.morans_i, got.z_score, got.mean_neighbors) == pytest.approx((i, (i - expected) / math.sqrt(variance), links / n))


@pytest.mark.usefixtures("no_pairs")
@pytest.mark.parametrize("standardize", [True, False])
def test_general_g_without_pairs(spark, standardize):
    rows = crowd()
    got = N.getis_ord_general_g(frame(spark, rows), "v", BAND, standardize=standardize).first()
    v, w = np.array([r[3] for r in rows]), (far(rows) <= BAND) * 1.0
    if standardize:
        w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    below = v.sum() ** 2 - (v * v).sum()
    assert (got.observed_g, got.expected_g) == pytest.approx((v @ w @ v / below, w.sum() / (len(v) * (len(v) - 1))))


@pytest.mark.usefixtures("no_pairs")
def test_incremental_autocorrelation_without_pairs(spark):
    rows = crowd()
    got = N.incremental_spatial_autocorrelation(frame(spark, rows), "v", 4.0, 5.0, 3).orderBy("distance").collect()
    d, v, n = far(rows), np.array([r[3] for r in rows]), len(rows)
    for r, at in zip(got, (4.0, 9.0, 14.0)):
        s0, _, _, cross = moments((d <= at) * 1.0, v)
        assert (r.distance, r.morans_i) == pytest.approx((at, n / s0 * cross / (v.var() * n)))


@pytest.mark.usefixtures("no_pairs")
def test_nearby_summaries_without_pairs(spark):
    rows, own = crowd(), crowd(60, 5)
    values = frame(spark, [*rows, (900, 7.0, 8.0, None), (901, None, 8.0, 3.0)])
    got = {(r.input_id, r.distance): (r["count"], r.sum_v, r.mean_v) for r in P.summarize_nearby(frame(spark, [*own, (70, None, None, 1.0), (71, 9e3, 9e3, 1.0)]), values, [3.0, BAND], ["v"]).collect()}
    for i, x, y, _ in own:
        for at in (3.0, BAND):
            met = [r[3] for r in [*rows, (900, 7.0, 8.0, 0.0)] if math.sqrt((r[1] - x) ** 2 + (r[2] - y) ** 2) <= at]
            assert got[str(i), at] == pytest.approx((len(met), sum(met), sum(met) / len(met) if met else 0.0))
    assert got["70", 3.0] == got["71", BAND] == (0, 0.0, 0.0) and len(got) == 2 * len(own) + 4


def test_a_summary_value_that_is_no_number_counts_only_where_it_is_near(spark):
    values = frame(spark, [(1, 0.0, 0.0, float("nan")), (2, 1.0, 0.0, 2.0), (3, 2.0, 0.0, 4.0)])
    got = {r.input_id: r.sum_v for r in P.summarize_nearby(values.where("fid > 1"), values, [1.0], ["v"]).collect()}
    assert math.isnan(got["2"]) and got["3"] == 6.0


@pytest.mark.usefixtures("no_pairs")
@pytest.mark.parametrize("weights", ["uniform", "inverse_distance"])
def test_neighbourhood_statistics_without_pairs(spark, weights):
    rows = [(i, x, y, None if i % 9 == 0 else v) for i, x, y, v in crowd()] + [(950, 5e3, 5e3, 1.0)]
    got = {r.fid: r for r in N.neighborhood_summary_statistics(frame(spark, rows), ["v"], distance=BAND, weights=weights).collect()}
    d = far(rows)
    for k, (i, *_) in enumerate(rows):
        near = [j for j in range(len(rows)) if d[k, j] <= BAND]
        known = [j for j in near if rows[j][3] is not None]
        assert got[i].nbr_count == len(near)
        if not known:
            assert (got[i].v_nbr_mean, got[i].v_nbr_median, got[i].v_nbr_sum) == (None, None, 0.0)
            continue
        v, w = np.array([rows[j][3] for j in known]), np.array([1.0 if weights == "uniform" else 1e9 if d[k, j] <= 1e-9 else 1 / d[k, j] for j in known])
        mean = (w @ v) / w.sum()
        want = (mean, np.median(v), math.sqrt((w @ (v - mean) ** 2) / w.sum()), v.min(), v.max(), v.sum())
        assert tuple(got[i][f"v_nbr_{s}"] for s in ("mean", "median", "std", "min", "max", "sum")) == pytest.approx(want, abs=1e-6)


@pytest.mark.usefixtures("no_pairs")
@pytest.mark.parametrize("estimator", ["mean", "median", "min", "max", "temporal_trend"])
def test_filling_within_a_radius_and_window_without_pairs(spark, estimator):
    rows = [(i, x, y, None if i % 4 == 0 else v, None if i % 31 == 5 else float(i % 10)) for i, x, y, v in crowd()] + [(950, 5e3, 5e3, None, 1.0)]
    df = spark.createDataFrame(rows, "fid long, x double, y double, v double, t double")
    got = {r.fid: (r.v, r.filled) for r in N.fill_missing_values(df, "v", estimator, radius=BAND, time="t", window=2.0).collect()}
    d = far(rows)
    for k, (i, _, _, v, t) in enumerate(rows):
        met = [] if v is not None else [r for j, r in enumerate(rows) if d[k, j] <= BAND and r[3] is not None and (t is None or r[4] is None or abs(r[4] - t) <= 2.0)]
        if not met:
            assert got[i] == (v, 0)
            continue
        u, at = np.array([r[3] for r in met]), np.array([r[4] or 0.0 for r in met])
        slope = ((at - at.mean()) @ (u - u.mean())) / ((at - at.mean()) @ (at - at.mean())) if np.ptp(at) else 0.0
        want = {"mean": u.mean(), "median": np.median(u), "min": u.min(), "max": u.max(), "temporal_trend": u.mean() + slope * ((t or 0.0) - at.mean())}
        assert got[i] == pytest.approx((want[estimator], 1))


@pytest.mark.usefixtures("no_pairs")
def test_near_tables_take_the_nearest_within_a_radius_without_pairs(spark):
    rows, own = crowd(), crowd(80, 5)
    got = sorted((r.in_fid, r.near_rank, r.near_fid) for r in P.generate_near_table(frame(spark, own), frame(spark, rows), 4.0, 3).collect())
    assert got == sorted((i, k + 1, j) for i, met in nearest(own, rows).items() for k, (d, j) in enumerate(met[:3]) if d <= 4.0)


@pytest.mark.usefixtures("no_pairs")
def test_links_take_the_nearest_of_their_id_without_pairs(spark):
    rows, own = crowd(), crowd(80, 5)
    origins, destinations = (frame(spark, r).selectExpr("fid", "x", "y", "IF(fid = 3, NULL, int(fid % 6)) AS link") for r in (own, rows))
    got = sorted((r.origin_id, r.dest_id, r.link_id) for r in P.generate_od_links(origins, destinations, by_link=True, num_nearest=2).collect())
    assert got == sorted((i, j, i % 6) for i, met in nearest(own, rows).items() if i != 3 for _, j in [m for m in met if m[1] % 6 == i % 6 and m[1] != 3][:2])


@pytest.mark.usefixtures("no_pairs")
def test_the_band_and_outliers_of_a_crowd_at_one_place_without_pairs(spark):
    rows = [(i, 1.0, 1.0, 0.0) for i in range(3000)] + [(3000 + i, 5.0 + i, 5.0, 0.0) for i in range(4)]
    got = {r.feature_id: r.kth_neighbor_distance for r in N.calculate_distance_band(frame(spark, rows), 2).collect()}
    assert len(got) == 3004 and {got[i] for i in range(3000)} == {0.0} and (got[3000], got[3001], got[3003]) == (2.0, 1.0, 2.0)
    found = {r.fid: (r.lof, r.is_outlier) for r in N.spatial_outlier_detection(frame(spark, rows), 2, threshold=2.0).collect()}
    assert {found[i] for i in range(3000)} == {(1.0, 0)} and len(found) == 3004


@pytest.mark.usefixtures("no_pairs")
@pytest.mark.parametrize("distance", [0.6, 2.0, 9.0])
def test_groups_by_proximity_without_pairs(spark, distance):
    rows = [(i, x, y, float(i % 2)) for i, x, y, _ in crowd()] + [(950, None, 1.0, 1.0), (951, 7.0, 7.0, None), (952, 7.0 + distance, 7.0, 0.0)]
    root, d = list(range(len(rows))), far([(i, math.nan if x is None else x, y, v) for i, x, y, v in rows])
    while True:
        new = [min([root[k], *(root[j] for j in range(len(rows)) if d[k, j] <= distance and rows[k][3] == rows[j][3] is not None)]) for k in range(len(rows))]
        if new == root:
            break
        root = new
    number = {r: n for n, r in enumerate(sorted(set(root)))}
    got = {r.fid: r.GROUP_ID for r in P.group_by_proximity(frame(spark, rows), distance, "v").collect()}
    assert got == {r[0]: number[root[k]] for k, r in enumerate(rows)}


def test_weights_of_a_band_are_not_sorted_by_origin(spark):
    rows = crowd()
    out = N.spatial_weights(frame(spark, rows), "inverse_distance", threshold=BAND)
    assert "Window" not in out._jdf.queryExecution().toString()
    d = far(rows)
    w = np.where((d <= BAND) & (d > 0), 1 / np.maximum(d, 1e-300), 0.0)
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    got = {(r.origin, r.neighbor): r.weight for r in out.collect()}
    assert got == pytest.approx({(i, j): w[i, j] for i, j in zip(*(a.tolist() for a in np.nonzero(w)))})


def test_space_time_matches_are_joined_once(spark, monkeypatch):
    from lodestone.plans import catalogue

    calls, pairs = [], P.pairs_within
    monkeypatch.setattr(P, "pairs_within", lambda *a, **k: calls.append(1) or pairs(*a, **k))
    catalogue.QUERIES["find_space_time_matches"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
