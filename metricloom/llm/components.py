"""Connected components of graphs given by edges, for components of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.settle import salted_join, settle


def components(edges: DataFrame) -> DataFrame:
    """`node`, `component` (its smallest node) of the nodes of undirected edges (`a`, `b`); nulls and loops are ignored.

    Alternating stars: every node tells its larger neighbours of the smallest node it knows (large star), then its smaller
    ones (small star), until nothing changes; the edges then point to the smallest node of their component. The number of
    rounds grows with the logarithm of the component size. Rounds are written, hot nodes split, and edges never multiply.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        large = _star(now, larger=True)
        now = _star(large, larger=False)
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (u > v) after a step: the larger neighbours of a node, or the node with its smaller ones, are linked to the
    smallest of the node and its neighbours."""
    sides = edges.select("u", F.col("v").alias("w"))
    if larger:
        sides = settle(sides.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("w"))))
    least = sides.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = salted_join(sides, least, ["u"], plain_rows=0)
    if larger:
        linked = joined.where("w > u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("w").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return settle(linked.where("u <> v").distinct())
