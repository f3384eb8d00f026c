"""Connected components of a graph that only the cluster can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm._base import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100, known: DataFrame | None = None) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b).

    component is the smallest node that can be reached.  Loops, repeated edges
    and edges with a null end count for nothing; no edges give no rows.

    Large and small stars alternate until only stars are left, which takes
    rounds in the order of the logarithm of the longest chain.  Every step is a
    minimum with map-side combine and one join; the minima are written first,
    so that adaptive execution can split the edges of a hub.

    known, a written table, is the outcome for other edges: the result is that
    for both, by rounds over the edges between its components alone.
    """
    if known is not None:
        return _joined(edges, scratch, max_rounds, known)
    now = scratch.table(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, both.where("b > a"), scratch)
        small = _star(large, large, scratch, own=True)
        scratch.drop(now, large)
        scratch.release()
        now = small
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _settled(now: DataFrame) -> bool:
    """Whether each a has one b that is no a itself: then the edges are the components."""
    ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)")
    return odd.agg(F.count("*")).first()[0] == 0


def _joined(edges: DataFrame, scratch: Scratch, max_rounds: int, known: DataFrame) -> DataFrame:
    """The components of known (node, component) with the edges (a, b) added."""
    between = edges.select("a", "b")
    for end in ("a", "b"):
        of = known.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        between = between.join(of, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_component", end)).select("a", "b")
    merged = scratch.table(connected_components(between, scratch, max_rounds))
    of = merged.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    before = known.join(of, known["component"] == of["_node"], "left")
    before = before.select("node", F.coalesce("_component", "component").alias("component"))
    out = scratch.table(before.unionByName(merged.join(known, "node", "left_anti")))
    scratch.drop(merged)
    return out


def _star(near: DataFrame, moved: DataFrame, scratch: Scratch, own: bool = False) -> DataFrame:
    """Each moved (a, b) as an edge from b to the least neighbour of a; own: from a as well."""
    least = scratch.table(near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    out = moved.join(least, "a").select(F.col("b").alias("x"), "m")
    if own:
        out = out.unionByName(least.select(F.col("a").alias("x"), "m"))
    out = out.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()
    done = scratch.table(out)
    scratch.drop(least)
    return done
