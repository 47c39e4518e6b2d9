"""Points that meet within a radius, worked on by numpy in blocks of the plane.

A block is a square of grid cells. Its points of the first side meet those of the second in it and around it, in one task
that holds both as columns; crowded blocks are dealt into chunks, each of which gets the second side anew. A task so
holds the points around one block and no table of pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Blocks hold about this many points where cells are small, and chunks at least this many.
BLOCK_POINTS, CHUNK_POINTS = 4096, 1024
#: A large input is dealt into about this many chunks.
CHUNKS = 96
#: Distances that are held at once.
MATRIX = 1 << 16


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def wider(radius: float) -> float:
    """A size of cells of which points within ``radius`` are never two apart, however quotients are rounded."""
    return radius * (1 + 1e-9)


def met_in_blocks(first: DataFrame, second: DataFrame, radius: float, f, schema: str, on: list[str] = ()) -> DataFrame:
    """Rows of ``schema`` that f makes of two tables and their ``meetings``: each row of ``first`` (a_x, a_y, ...) is in one of them,
    with all rows of ``second`` (b_x, b_y, ...) within ``radius`` in x and in y and of equal values of ``on``, and others to pass
    over. Coordinates must be finite and values of ``on`` known; both sides are read more than once."""
    on, size = list(on), wider(radius)
    a = first.withColumn("_cx", cell(F.col("a_x"), size)).withColumn("_cy", cell(F.col("a_y"), size))
    crowd = a.groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0] or 1
    wide = max(1, min(16, int(math.sqrt(BLOCK_POINTS / crowd))))

    def block(c: Column) -> Column:
        return F.floor(c / wide).cast("long")

    a = a.withColumn("_cx", block(F.col("_cx"))).withColumn("_cy", block(F.col("_cy")))
    counts = stored(a.groupBy("_cx", "_cy").agg(F.count("*").alias("_n")).withColumn("_u", F.monotonically_increasing_id()), "blocks")
    chunk = max(CHUNK_POINTS, (counts.agg(F.sum("_n")).first()[0] or 0) // CHUNKS)
    blocks = counts.withColumn("_k", F.ceil(F.col("_n") / chunk).cast("long")).drop("_n")
    units = blocks.agg(F.sum("_k")).first()[0] or 1
    groups = min(units, max(384, units // 32))

    def around(c: str) -> Column:
        return F.explode(F.array_distinct(F.array(*(block(cell(F.col(c), size) + d) for d in (-1, 0, 1)))))

    def dealt(df: DataFrame, names: list[str], part: Column) -> DataFrame:
        unit = (F.col("_u") * 65536 + F.col("_part")).alias("_unit")
        df = df.join(blocks, ["_cx", "_cy"]).withColumn("_part", part).select(unit, *names)
        return df.withColumn("_g", F.pmod(F.xxhash64("_unit"), F.lit(groups))).repartition(groups, "_g")

    sent = second.withColumn("_cx", around("b_x")).withColumn("_cy", around("b_y"))
    left = dealt(a, first.columns, F.pmod(F.xxhash64("a_x", "a_y"), "_k"))
    right = dealt(sent, second.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        return f(*meetings(a, b, size, ["_unit", *on]))

    return left.groupBy("_g").cogroup(right.groupBy("_g")).applyInArrow(work, schema)


def column(table: pa.Table, name: str) -> np.ndarray:
    """A numeric column, nulls as NaN."""
    return table.column(name).to_numpy()


def _codes(a: pa.Table, b: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tuples of some columns, equal for equal ones of both tables."""
    code = np.zeros(len(a) + len(b), "int64")
    for name in names:
        met = pa.chunked_array(a.column(name).chunks + b.column(name).chunks).combine_chunks().dictionary_encode()
        _, code = np.unique(code * len(met.dictionary) + met.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    return code[: len(a)], code[len(a) :]


def _steps(a: np.ndarray, b: np.ndarray, size: float, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Cell numbers from ``most`` on, gaps between them cut to ``most`` + 1, which keeps apart what is, and what is beyond all."""
    known, at = np.unique(np.floor(np.concatenate([a, b]) / size), return_inverse=True)
    to = np.concatenate([[0], np.cumsum(np.minimum(np.diff(known), most + 1))]).astype("int64")[at] + most
    return to[: len(a)], to[len(a) :], int(to.max()) + most + 1


def meetings(a: pa.Table, b: pa.Table, size: float, names: list[str]) -> tuple[pa.Table, pa.Table, list]:
    """Both tables in the order of their cells, and the meetings: a slice of a, that of one cell, and slices of b, which hold
    the cells around it with equal ``names``."""
    if not len(a) or not len(b):
        return a, b, []
    ax, ay, bx, by = (column(t, f"{s}_{c}") for t, s in ((a, "a"), (b, "b")) for c in "xy")
    ka, kb = _codes(a, b, names)
    # Where cells hold many, smaller ones leave less to pass over.
    fine = 4 if len(a) > 256 * len(np.unique(np.floor(ax / size) + 1j * np.floor(ay / size))) else 1
    (xa, xb, nx), (ya, yb, ny) = _steps(ax, bx, size / fine, fine), _steps(ay, by, size / fine, fine)
    ca, cb = (ka * nx + xa) * ny + ya, (kb * nx + xb) * ny + yb
    ao, bo = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, cb = ca[ao], cb[bo]
    cells, starts = np.unique(ca, return_index=True)
    ends = np.append(starts[1:], len(ca))
    rows = [(np.searchsorted(cb, cells + d * ny - fine, "left"), np.searchsorted(cb, cells + d * ny + fine, "right")) for d in range(-fine, fine + 1)]
    met = ((slice(starts[i], ends[i]), [slice(lo[i], hi[i]) for lo, hi in rows if hi[i] > lo[i]]) for i in range(len(cells)))
    return a.take(pa.array(ao)), b.take(pa.array(bo)), ((at, slices) for at, slices in met if slices)


def pick(values: np.ndarray, slices: list[slice]) -> np.ndarray:
    return np.concatenate([values[s] for s in slices])


def squares(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray):
    """Slices of a with the squared distances of its points from those of b, a few rows at a time."""
    step = max(1, MATRIX // len(bx))
    for i in range(0, len(ax), step):
        j = slice(i, min(i + step, len(ax)))
        d, e = bx - ax[j, None], by - ay[j, None]
        d *= d
        e *= e
        d += e
        yield j, d


def square_limit(radius: float) -> float:
    """The greatest number whose root is at most ``radius``."""
    t = radius * radius
    while math.sqrt(math.nextafter(t, math.inf)) <= radius:
        t = math.nextafter(t, math.inf)
    while math.sqrt(t) > radius:
        t = math.nextafter(t, 0.0)
    return t
