"""Joins of points by distance, through a grid of cells as large as the search radius or a part of it: a point's partners lie in
its own cell or those around it, so the second side is sent to all of these and joined by cell. No side is
broadcast or crossed; a crowded cell is dealt into chunks. What needs no table of pairs, nearest neighbours and
sums over neighbours, is worked out by numpy in blocks of the plane."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import cell, column, met_in_blocks, pick, square_limit, squares, wider
from ..functions.graph import components
from ..functions.ranking import global_row_number
from ..functions.storage import stored
from .table import finite


#: Cells of more points of the first side are dealt into chunks, each of which gets the second side anew.
CELL_POINTS = 4096


def pairs_within(first: DataFrame, second: DataFrame, radius: float, on: list[str] = (), parts: int = 1) -> DataFrame:
    """Pairs of points (a_id, a_x, a_y) and (b_id, b_x, b_y) at most ``radius`` apart, with their dist; further
    columns come along, and those of ``on`` must be equal and not null. Cells of a ``parts``-th of the radius leave fewer pairs
    to pass over and spread the work, but the second side is sent to (2 * parts + 1) ** 2 of them.

    Small files are large tables once they have met, so neither side is broadcast and no partitions are merged for their size."""
    if radius <= 0:
        raise ValueError("the radius must be positive")
    size, steps = wider(radius) / parts, F.array(*(F.lit(d) for d in range(-parts, parts + 1)))
    keys, tasks = ["_cx", "_cy", *on], int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = first.withColumn("_cx", cell(F.col("a_x"), size)).withColumn("_cy", cell(F.col("a_y"), size))
    sent = second.select("*", F.explode(steps).alias("_dx")).select("*", F.explode(steps).alias("_dy"))
    sent = sent.withColumn("_cx", cell(F.col("b_x"), size) + F.col("_dx")).withColumn("_cy", cell(F.col("b_y"), size) + F.col("_dy")).drop("_dx", "_dy")
    chunks = a.groupBy(*keys).agg(F.ceil(F.count("*") / CELL_POINTS).cast("long").alias("_k"))
    a = a.join(chunks, keys).withColumn("_part", F.pmod(F.xxhash64("a_id"), "_k")).drop("_k")
    sent = sent.join(chunks, keys).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))).drop("_k")
    keys = [*keys, "_part"]
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    met = a.repartition(tasks, *keys).hint("merge").join(sent.repartition(tasks, *keys), keys).drop("_cx", "_cy", "_part")
    return met.withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= radius)


def _side(points: DataFrame, side: str, more: list[str] = (), carried: list[str] = ()) -> DataFrame:
    """The points (fid, x, y) that have coordinates, as columns of one side of a join; ``more`` must be known too, ``carried`` need not."""
    x, y = finite("x"), finite("y")
    placed = reduce(Column.__and__, [F.col(c).isNotNull() for c in more], x.isNotNull() & y.isNotNull())
    return points.where(placed).select(F.col("fid").alias(f"{side}_id"), x.alias(f"{side}_x"), y.alias(f"{side}_y"), *more, *carried)


def within(points: DataFrame, radius: float) -> DataFrame:
    """Ordered pairs of different points (fid, x, y) at most ``radius`` apart, as pairs_within names them."""
    return pairs_within(_side(points, "a"), _side(points, "b"), radius).where("a_id <> b_id")


def sums_within(points: DataFrame, targets: DataFrame, radii: list[float], fields: list[str], exponent: float = 0.0) -> DataFrame:
    """Per place (x, y) of points and n-th radius the sums of the fields of all targets (x, y, fields) within it, as
    ``<field>_<n>``, a missing value counting as 0. With an exponent, targets at the place itself are left out, and
    ``<field>_<n>_1`` and ``_2`` sum the fields times that power of the reciprocal distance, and times its square.

    Targets are added up by place first; no pairs are stored or sent."""
    x, y = finite("x"), finite("y")
    a = stored(points.select(x.alias("a_x"), y.alias("a_y")).where("a_x IS NOT NULL AND a_y IS NOT NULL").distinct(), "places")
    sums = [F.sum(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in fields]
    b = stored(targets.where(x.isNotNull() & y.isNotNull()).groupBy(x.alias("b_x"), y.alias("b_y")).agg(*sums), "targets")
    limits, powers = [square_limit(float(r)) for r in radii], [0, 1, 2] if exponent else [0]
    names = [f"{f}_{n}" + (f"_{p}" if p else "") for n in range(len(radii)) for p in powers for f in fields]

    def add(a, b, met):
        ax, ay, bx, by = (column(t, f"{s}_{c}") for t, s in ((a, "a"), (b, "b")) for c in "xy")
        values = np.column_stack([column(b, f) for f in fields])
        odd = ~np.isfinite(values)
        plain, odd = np.where(odd, 0.0, values), np.flatnonzero(odd.any(axis=1))
        out = np.zeros((len(a), len(radii), len(powers), len(fields)))
        strange = np.zeros(len(b), bool)
        strange[odd] = True
        for at, slices in met:
            v, u = pick(plain, slices), np.flatnonzero(pick(strange, slices))
            w = pick(values, slices)[u]
            for rows, d in squares(ax[at], ay[at], pick(bx, slices), pick(by, slices)):
                to = out[at][rows]
                for n, limit in enumerate(limits):
                    near = d <= limit
                    if exponent:
                        near &= d > 0
                        weight = np.zeros_like(d)
                        np.divide(1.0, np.sqrt(d) if exponent == 1 else np.sqrt(d) ** exponent, out=weight, where=near)
                    for p in powers:
                        factor = near.astype("float64") if p == 0 else weight if p == 1 else weight * weight
                        to[:, n, p] = factor @ v
                        # A product with zero would make these count where they are not near.
                        if len(u):
                            to[:, n, p] += np.where(near[:, u, None], factor[:, u, None] * w, 0.0).sum(axis=1)
        return pa.table([a.column("a_x"), a.column("a_y"), *(pa.array(c) for c in np.ascontiguousarray(out.reshape(len(a), len(names)).T))], ["x", "y", *names])

    schema = ", ".join(["x double", "y double", *(f"`{c}` double" for c in names)])
    return met_in_blocks(a, b, max(radii), add, schema)


def knn(points: DataFrame, k: int, targets: DataFrame | None = None, metric: str = "euclidean", on: list[str] = (), limit: float | None = None) -> DataFrame:
    """The ``k`` nearest targets of every point, or without targets the nearest other points: a_id, a_x, a_y, b_id,
    b_x, b_y, dist and rank, by distance and then b_id. Columns of ``on`` must be equal and come along; beyond ``limit`` is none.

    Points look within a radius at which the most crowded grid cell holds a few times k of them, and those that met fewer than k
    again within twice that, so crowds are not paired at the radius that empty regions need. Of coincident targets the k of the least
    ids are enough (one more where a point may be its own). The number of rounds grows with the logarithm of the unevenness."""
    if k < 1:
        raise ValueError("k must be positive")
    same, on = targets is None, list(on)
    left, right = stored(_side(points, "a", on), "knn-points"), _side(points if same else targets, "b", on)
    place = Window.partitionBy("b_x", "b_y", *on).orderBy("b_id")
    right = right.withColumns({c: F.col(c).cast(left.schema[c].dataType) for c in on})
    right = stored(right.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k + same).drop("_r"), "knn-targets")
    x, y = F.col("x"), F.col("y")
    box = left.select("a_x", "a_y").union(right.select("b_x", "b_y")).toDF("x", "y").agg(F.max(x) - F.min(x), F.max(y) - F.min(y)).first()
    width, height, n = box[0] or 0.0, box[1] or 0.0, max(right.count() / max(right.select(*on).distinct().count() if on else 1, 1), 1)
    reach = (math.hypot(width, height) if metric == "euclidean" else width + height) * (1 + 1e-9) or 1.0
    size = min(reach, max(math.sqrt(width * height * (k + 1) / n), reach * (k + 1) / n))
    crowd = right.groupBy(cell(F.col("b_x"), size), cell(F.col("b_y"), size), *on).count().agg(F.max("count")).first()[0] or 1
    reach = reach if limit is None else min(reach, limit)
    radius, found = min(1.6 * size / math.sqrt(max(1.0, crowd / (k + 1))), reach), []
    kinds = dict(left.dtypes) | dict(right.dtypes)
    names = ["a_id", "a_x", "a_y", "b_id", "b_x", "b_y", *on]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "dist double", "rank long"])
    while True:
        last = radius >= reach
        near = stored(met_in_blocks(left, right, radius, _nearest(k, radius, metric, same, last, names), schema, on), "knn-near")
        found.append(near)
        if last:
            break
        left = stored(left.join(near.where(F.col("rank") == k).select("a_id"), "a_id", "left_anti"), "knn-points")
        if left.isEmpty():
            break
        radius = min(2 * radius, reach)
    return reduce(DataFrame.union, [df.select("a_id", "a_x", "a_y", "b_id", "b_x", "b_y", "dist", "rank", *on) for df in found])


def _nearest(k: int, radius: float, metric: str, same: bool, last: bool, names: list[str]):
    """What finds in a block the k nearest of each point, of points that met fewer only if ``last``."""

    def find(a, b, met):
        ax, ay, bx, by = (column(t, f"{s}_{c}") for t, s in ((a, "a"), (b, "b")) for c in "xy")
        ids = pa.chunked_array(b.column("b_id").chunks + (a.column("a_id").chunks if same else []), b.schema.field("b_id").type)
        order = np.asarray(pc.rank(ids, tiebreaker="dense"), "int64")
        own, order = order[len(b) :], order[: len(b)]
        parts = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
        for at, slices in met:
            to = np.concatenate([np.arange(s.start, s.stop) for s in slices])
            for rows, d in squares(ax[at], ay[at], bx[to], by[to]):
                if metric == "manhattan":
                    d = np.abs(bx[to] - ax[at][rows, None]) + np.abs(by[to] - ay[at][rows, None])
                else:
                    np.sqrt(d, out=d)
                if same:
                    d[own[at][rows, None] == order[to]] = np.inf
                far = np.partition(d, k - 1, axis=1)[:, k - 1] if len(to) > k else np.full(len(d), radius)
                p, q = np.nonzero(d <= np.minimum(far, radius)[:, None])
                parts.append((at.start + rows.start + p, to[q], d[p, q]))
        p, q, d = (np.concatenate(c) for c in zip(*parts))
        by_place = np.lexsort((order[q], d, p))
        p, q, d = p[by_place], q[by_place], d[by_place]
        count = np.bincount(p, minlength=len(a))
        rank = np.arange(len(p)) - (np.cumsum(count) - count)[p]
        kept = (rank < k) if last else (rank < k) & (count[p] >= k)
        p, q = pa.array(p[kept]), pa.array(q[kept])
        # What both sides have is equal.
        return pa.table([*((b if c[:2] == "b_" else a).column(c).take(q if c[:2] == "b_" else p) for c in names), pa.array(d[kept]), pa.array(rank[kept] + 1)], [*names, "dist", "rank"])

    return find


def generate_near_table(inputs: DataFrame, near: DataFrame, radius: float | None = None, closest_count: int = 1, same: bool = False) -> DataFrame:
    """Per input point (fid, x, y) its nearest points, within ``radius`` if that is given, ``closest_count`` of them or with 0
    all, by distance and then near_fid; the angle is counter-clockwise from east. With ``same`` no point meets itself."""
    if radius is None and not closest_count:
        raise ValueError("give a radius or a closest_count")
    rank = F.col("rank")
    if closest_count:
        met = knn(inputs, closest_count, None if same else near, limit=radius)
    else:
        met = pairs_within(_side(inputs, "a"), _side(near, "b"), radius)
        met = met.where("a_id <> b_id") if same else met
        rank = F.row_number().over(Window.partitionBy("a_id").orderBy("dist", "b_id")).cast("long")
    return met.select(
        F.col("a_id").alias("in_fid"), F.col("b_id").alias("near_fid"), F.col("dist").alias("near_dist"), rank.alias("near_rank"),
        F.col("b_x").alias("near_x"), F.col("b_y").alias("near_y"), F.degrees(F.atan2(F.col("b_y") - F.col("a_y"), F.col("b_x") - F.col("a_x"))).alias("near_angle"),
    )


def generate_od_links(origins: DataFrame, destinations: DataFrame, radius: float | None = None, by_link: bool = False, num_nearest: int | None = None) -> DataFrame:
    """Links of origins (fid, x, y, link) to destinations by equal link ids, within ``radius``, or both; then the
    ``num_nearest`` of each origin, ties in the order of the destinations; with neither, the ``num_nearest`` or
    the one nearest of all. Missing ids never match."""
    more = ["link"] if by_link else []
    if num_nearest is not None or not (by_link or radius is not None):
        met = knn(origins, num_nearest or 1, destinations, on=more, limit=radius)
    elif radius is not None:
        met = pairs_within(_side(origins, "a", more), _side(destinations, "b", more), radius, more)
    else:
        dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
        a = origins.select(F.col("fid").alias("a_id"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), *more)
        b = destinations.select(F.col("fid").alias("b_id"), F.col("x").alias("b_x"), F.col("y").alias("b_y"), *more)
        met = a.join(b, "link").withColumn("dist", F.sqrt(dx * dx + dy * dy))
    return met.select(F.col("a_id").alias("origin_id"), F.col("b_id").alias("dest_id"), F.col("dist").alias("length"), *(F.col(c).alias("link_id") for c in more))


def find_space_time_matches(primary: DataFrame, secondary: DataFrame, radius: float, window: float, relation: str = "within") -> DataFrame:
    """Pairs of fixes (fid, x, y, t) at most ``radius`` and ``window`` apart; the secondary one lies before, after or
    on either side. All bounds are inclusive; delta_t is secondary less primary."""
    a = primary.select(F.col("fid").alias("a_id"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), F.col("t").alias("a_t"), cell(F.col("t"), window).alias("_ct"))
    sent = secondary.select(F.col("fid").alias("b_id"), F.col("x").alias("b_x"), F.col("y").alias("b_y"), F.col("t").alias("b_t"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_dt"))
    b = sent.withColumn("_ct", cell(F.col("b_t"), window) + F.col("_dt")).drop("_dt")
    delta = F.col("b_t") - F.col("a_t")
    low, high = {"within": (-window, window), "before": (-window, 0.0), "after": (0.0, window)}[relation]
    met = pairs_within(a, b, radius, ["_ct"]).withColumn("delta_t", delta).where(F.col("delta_t").between(low, high))
    return met.select(F.col("a_id").alias("primary_id"), F.col("b_id").alias("secondary_id"), F.col("dist").alias("distance"), "delta_t")


def points_to_line(df: DataFrame, key: str, order: str, x: str, y: str, row_id: str, close: bool = False) -> DataFrame:
    """A line per key through its points in order: the key as text, point_count (with the closing vertex), length and
    path, an array of (x, y). Keys of fewer than two points have none. A line is one row, so its vertices meet in one task."""
    vertices = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(row_id).alias("r"), F.col(x).alias("x"), F.col(y).alias("y"))))
    lines = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(F.transform(vertices, lambda p: F.struct(p["x"], p["y"])).alias("path"))
    lines = lines.where(F.size("path") > 1)
    if close:
        lines = lines.withColumn("path", F.when(F.get("path", F.lit(0)) == F.element_at("path", -1), F.col("path")).otherwise(F.concat("path", F.slice("path", 1, 1))))
    legs = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))
    step = F.transform(legs, lambda s: F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], F.lit(2.0)) + F.pow(s["b"]["y"] - s["a"]["y"], F.lit(2.0))))
    return lines.select(key, F.size("path").cast("long").alias("point_count"), F.aggregate(step, F.lit(0.0), lambda a, s: a + s).alias("length"), "path")


def dissolve_route_events(df: DataFrame, route: str, start: str, end: str, fields: list[str], row_id: str, tolerance: float = 0.0, mode: str = "dissolve", separator: str = ",") -> DataFrame:
    """Events of a route merged where they meet or overlap within ``tolerance``: those of equal field values, or with
    ``concatenate`` all, their distinct values joined in the order met. Reversed measures are swapped; rows without
    both are left out. EVENT_COUNT says how many were merged."""
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = rows.withColumn("_lo", F.least(start, end)).withColumn("_hi", F.greatest(start, end))
    rows = rows.withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields})
    keys = [route, *fields] if mode == "dissolve" else [route]
    w = Window.partitionBy(*keys).orderBy("_lo", row_id)
    reached = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.coalesce(F.col("_lo") > reached + tolerance, F.lit(True)).cast("long"))
    parts = marked.withColumn("_part", F.sum("_new").over(w)).groupBy(*keys, "_part")

    def distinct(f: str) -> Column:
        met = F.array_sort(F.collect_list(F.struct("_lo", row_id, f)))
        return F.array_join(F.array_distinct(F.transform(met, lambda s: s[f])), separator).alias(f)

    joined = [distinct(f) for f in fields] if mode == "concatenate" else []
    out = parts.agg(F.min("_lo").alias(start), F.max("_hi").alias(end), F.count("*").alias("EVENT_COUNT"), *joined)
    return out.select(route, start, end, *fields, "EVENT_COUNT")


def group_by_proximity(points: DataFrame, distance: float, attribute: str | None = None, group_field: str = "GROUP_ID") -> DataFrame:
    """Points (fid, x, y, ...) with the 0-based number of their group: those that steps of at most ``distance`` join, of equal
    values of ``attribute`` if that is given. Groups are numbered by their least fid; a null attribute is in no other's group."""
    if distance <= 0:
        raise ValueError("the distance must be positive")
    on = [attribute] if attribute else []
    # Points of one cell are all within the distance, so a cell is one node, and only whether cells hold a near pair is asked.
    size, cells = distance / math.sqrt(2.0) * (1 - 1e-9), [*on, "_cx", "_cy"]
    celled = points.withColumn("_cx", cell(finite("x"), size)).withColumn("_cy", cell(finite("y"), size))
    placed = reduce(Column.__and__, [F.col(c).isNotNull() for c in cells])
    nodes = stored(celled.where(placed).groupBy(*cells).agg(F.min("fid").alias("node")), "nodes")
    rows = celled.where(placed).select(*cells, finite("x").alias("x"), finite("y").alias("y")).distinct().join(nodes, cells)
    a, b = (stored(rows.select(F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"), F.col("_cx").alias(f"{s}_cx"), F.col("_cy").alias(f"{s}_cy"), F.col("node").alias(f"{s}_node"), *on), "points") for s in "ab")
    kind = dict(a.dtypes)["a_node"]
    roots = components(met_in_blocks(a, b, distance, _linked(distance), f"a {kind}, b {kind}", on))
    if roots is None:
        rooted = celled.join(nodes, cells, "left").withColumn("_root", F.coalesce("node", "fid")).drop("node")
    else:
        nodes = nodes.join(roots.toDF("node", "_r"), "node", "left").select(*cells, F.coalesce("_r", "node").alias("_r"))
        rooted = celled.join(nodes, cells, "left").withColumn("_root", F.coalesce("_r", "fid")).drop("_r")
    rooted = rooted.select(*points.columns, "_root")
    numbers = global_row_number(rooted.select("_root").distinct(), [F.col("_root")], group_field)
    return rooted.join(numbers, "_root").withColumn(group_field, F.col(group_field) - 1).drop("_root")


def _linked(distance: float):
    """What finds in a block the pairs of different nodes that hold points at most ``distance`` apart."""
    limit = square_limit(float(distance))

    def near(ax, ay, bx, by) -> bool:
        # Only points that the box around the other side's can reach.
        apart = [np.maximum(np.maximum(q.min() - p, p - q.max()), 0.0) <= distance * (1 + 1e-9) for p, q in ((ax, bx), (ay, by), (bx, ax), (by, ay))]
        ax, ay, bx, by = ax[apart[0] & apart[1]], ay[apart[0] & apart[1]], bx[apart[2] & apart[3]], by[apart[2] & apart[3]]
        return len(ax) > 0 and len(bx) > 0 and any((d <= limit).any() for _, d in squares(ax, ay, bx, by))

    def find(a, b, met):
        ax, ay, bx, by, acx, acy, bcx, bcy = (column(t, f"{s}_{c}") for names in (("x", "y"), ("cx", "cy")) for t, s in ((a, "a"), (b, "b")) for c in names)
        ids = pa.chunked_array(a.column("a_node").chunks + b.column("b_node").chunks, a.schema.field("a_node").type).combine_chunks().dictionary_encode()
        code = ids.indices.to_numpy(zero_copy_only=False)
        na, nb = code[: len(a)], code[len(a) :]
        found = set()
        for at, slices in met:
            to = np.concatenate([np.arange(s.start, s.stop) for s in slices])
            to = to[np.argsort(nb[to], kind="stable")]
            own = np.arange(at.start, at.stop)[np.argsort(na[at], kind="stable")]
            theirs = np.split(to, np.flatnonzero(np.diff(nb[to])) + 1)
            for mine in np.split(own, np.flatnonzero(np.diff(na[own])) + 1):
                x, y, i = acx[mine[0]], acy[mine[0]], na[mine[0]]
                for other in theirs:
                    dx, dy, j = bcx[other[0]] - x, bcy[other[0]] - y, nb[other[0]]
                    # The pair is met from the other side too, and maybe in other cells.
                    if (dx, dy) > (0, 0) and dx <= 2 and abs(dy) <= 2 and (i, j) not in found and near(ax[mine], ay[mine], bx[other], by[other]):
                        found.add((i, j))
        p, q = (np.array([e[n] for e in found], "int64") for n in (0, 1))
        return pa.table([ids.dictionary.take(pa.array(p)), ids.dictionary.take(pa.array(q))], ["a", "b"])

    return find


def summarize_nearby(points: DataFrame, summary: DataFrame, distances: list[float], fields: list[str] = ()) -> DataFrame:
    """Per input point and distance the count of the summary points (fid, x, y, fields) within it, and the sum and mean of
    their fields, a missing value counting as 0. Rings without points have zeros."""
    reach = [float(d) for d in distances]
    met = sums_within(points, summary.select("x", "y", F.lit(1.0).alias("_count"), *fields), reach, ["_count", *fields])
    rings = F.array(*(F.struct(F.lit(d).alias("distance"), F.col(f"_count_{n}").alias("count"), *(F.col(f"{f}_{n}").alias(f"sum_{f}") for f in fields)) for n, d in enumerate(reach)))
    placed = points.select(F.col("fid").alias("a_id"), finite("x").alias("x"), finite("y").alias("y"))
    every = placed.join(met, ["x", "y"], "left").select("a_id", F.inline(rings))
    sums = [F.coalesce(f"sum_{f}", F.lit(0.0)).alias(f"sum_{f}") for f in fields]
    means = [F.coalesce(F.try_divide(f"sum_{f}", "count"), F.lit(0.0)).alias(f"mean_{f}") for f in fields]
    return every.select(F.col("a_id").cast("string").alias("input_id"), "distance", F.coalesce("count", F.lit(0)).cast("long").alias("count"), *sums, *means)
