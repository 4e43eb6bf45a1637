"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Store, join_by_size


def _settled(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with m, the least v of their u; the many edges of a hub stay where they are."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_by_size(edges, least, ["u"], "n", total).select("u", "v", "m")


def connected_components(edges: DataFrame, store: Store, rounds: int = 200) -> DataFrame:
    """(id, root) of every end of ``edges`` (a, b): root is the smallest id reachable.

    Each round hangs the neighbours of a node on the smallest of them, so that
    the number of rounds grows with the logarithm of the graph. Minima are combined
    before the shuffle, and the edges of hubs, of which there can be only so many,
    meet them by broadcast instead. Loops, repeated, reversed and null edges are
    allowed; ends of null edges are left out. Rounds are written to the shared
    folder. A graph that isn't settled after ``rounds`` rounds is an error.
    """
    whole = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    now = store.keep(
        whole.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        mark = _settled(now)
        if mark == before or mark[0] == 0:
            break
        before = mark
        # large star: larger neighbours of u hang on the smallest neighbour of u, or on u if that is smaller
        proper = now.where("u <> v")
        both = proper.unionByName(proper.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        small = _with_least(large, mark[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = store.keep(small.where("u <> v").distinct(), "edges")
        store.drop(now)
        now = after
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    ends = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return ends.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()).groupBy("id").agg(F.min("root").alias("root"))
