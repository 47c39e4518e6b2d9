"""Connected components of a stored edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored


def components(edges: DataFrame) -> DataFrame | None:
    """(id, root) of the nodes of edges (a, b), the least node each can reach; None without edges.

    Each node hooks to its least neighbour, hooks are followed twice, and the edges are
    contracted to those between different roots, until none is left."""
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = stored(edges.where("a <> b").select(*ends).distinct(), "edges")
    roots = None
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        hook = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("up")), "hooks")
        up = hook.select(F.col("id").alias("up"), F.col("up").alias("root"))
        jump = stored(hook.join(up, "up").select("id", "root"), "jumps")
        a, b = jump.toDF("a", "x"), jump.toDF("b", "y")
        met = left.join(a, "a").join(b, "b").where("x <> y")
        rest = stored(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if roots is None:
            after = jump
        else:
            after = stored(roots.join(jump.toDF("root", "top"), "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots")
            discard(roots, jump)
        discard(left, hook)
        left, roots = rest, after
    discard(left)
    return roots
