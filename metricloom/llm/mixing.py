"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size takes floor(r) copies of every document, and one more of some: all documents, large
or small, are included with the same probability, the rest of r. The flight phase moves these probabilities through the null
space of the balancing constraints (token total and document total) until all but two of a block are 0 or 1; what is left of
the blocks meets in larger blocks, and so on until one block per source remains. A document so large that the others cannot
make way for it with both totals kept moves with the token total alone. The landing problem are the last undecided documents:
with two of them the token total is still kept, the last is drawn. They are the smallest ones, unless taking a single document
is more than all the source is short of.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.settle import prefix_sums, salted_join, settle
from .rows import numbered
from .text import importable

BLOCK = 4096
MOST = 3.0
# A table of this many sources is broadcast; more are joined by key, split where a source is hot.
FEW_SOURCES = 10_000
EPS = 1e-9


def targets(sizes: DataFrame) -> DataFrame:
    """`key`, `source_size`, `target` for rows (key, size): weights 1, 2, 3, repeating, in the order of the keys.

    A target stops at MOST times the source's size, the excess goes to the others by weight. The common level x of
    min(MOST * size, x * weight) that uses everything up is the largest of those that follow from capping the first m
    sources by size per weight, m = 0, 1, ...: each of these is a lower bound, and one of them is exact.
    """
    placed = numbered(sizes, ["key"], "place").withColumn("weight", F.col("place") % 3 + 1)
    capped = placed.withColumn("most", MOST * F.col("size")).withColumn("by", F.struct(F.col("most") / F.col("weight"), "place"))
    summed = settle(prefix_sums(capped.withColumns({"p": F.col("most"), "w": F.col("weight")}), [], "by", {"p": "p", "w": "w"}))
    total = summed.agg(F.sum("size"), F.sum("weight")).first()
    rest = F.lit(total[1]) - F.col("w") + F.col("weight")
    level = summed.agg(F.max((F.lit(float(total[0] or 0)) - F.col("p") + F.col("most")) / rest)).first()[0] or 0.0
    share = F.least(F.col("most"), F.lit(float(level)) * F.col("weight"))
    return summed.select("key", F.col("size").alias("source_size"), share.cast("double").alias("target"))


def flight(p: np.ndarray, size: np.ndarray, land: bool, seed: int = 0) -> np.ndarray:
    """Inclusion probabilities after the flight: all 0 or 1 but for two, with the sum of p * size kept, and that of p unless a
    large unit needs it given up.

    Units are decided from the largest down. Each step goes along a direction of the constraints' null space: the unit at hand
    moves, and all undecided smaller ones yield in proportion to p (1 - p), until a probability gets to 0 or 1. Of the two ways
    to go one is drawn so that every expectation stays, by a generator that depends on the block and the seed alone. With
    `land` the last two, the smallest units, are decided as well: keeping the token total as long as there are two, by a draw
    in the end.
    """
    rng = np.random.default_rng([len(p), int(size.sum()) & 0x7FFFFFFF, seed])
    order = np.argsort(-size, kind="stable")
    q, s = np.clip(p[order].astype(np.float64), 0, 1), size[order].astype(np.float64)
    q[q <= EPS], q[q >= 1 - EPS] = 0, 1
    inside = np.flatnonzero((q > 0) & (q < 1))
    while len(inside) > 2 or land and len(inside):
        x = q[inside]
        u, up, down = _step(x, s[inside], both=True)
        if up < 1 - x[0] - EPS or down < x[0] - EPS:
            alone = _step(x, s[inside], both=False)
            if alone[1] >= 1 - x[0] - EPS and alone[2] >= x[0] - EPS:
                u, up, down = alone
        x = x + (up if rng.random() * (up + down) < down else -down) * u
        q[inside] = np.where(x <= EPS, 0, np.where(x >= 1 - EPS, 1, x))
        inside = inside[(q[inside] > 0) & (q[inside] < 1)]
    out = np.empty_like(q)
    out[order] = q
    return out


def _step(x: np.ndarray, s: np.ndarray, both: bool) -> tuple[np.ndarray, float, float]:
    """A direction that keeps the token total, with `both` the sum of x too, and how far it leads up and down."""
    u = np.zeros(len(x))
    w, t = x[1:] * (1 - x[1:]), s[1:]
    n0, n1, n2 = w.sum(), (w * t).sum(), (w * t * t).sum()
    det = n0 * n2 - n1 * n1
    if len(x) > 2 and both and det > 1e-9 * n0 * n2:
        u[0], u[1:] = 1, w * ((n1 * s[0] - n2) + (n1 - n0 * s[0]) * t) / det
    elif len(x) > 2 and both:  # equal sizes: two of them make way for each other
        u[1], u[2] = 1, -1
    elif n1 > 0 and s[0] > 0:
        u[0], u[1:] = 1, -w * s[0] / n1
    else:
        u[0] = 1
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)).min()
        down = np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)).min()
    return u, up, down


def mix(docs: DataFrame, size: Column, source: str, seed: int = 0) -> DataFrame:
    """`row` (struct of all columns of `docs`), `size`, `source_size`, `target`, `copies` (how often the mix takes it).

    Sources are ordered by code point, null last (null is a source of its own). Documents of size 0, and sources without any
    size, are taken as their ratio says and add no words. Order inside a source is a hash of the whole row, so the result
    doesn't depend on partitions, and of rows equal in all columns it doesn't matter which is taken. No document is taken
    more than MOST times. An empty table gives no rows. Clashing names don't matter, the columns travel inside `row`.
    """
    importable(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("0"), F.col(f"`{source}`").cast("string")), F.lit("1"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = settle(docs.select(whole.alias("row"), key.alias("key"), size.cast("bigint").alias("size"), F.monotonically_increasing_id().alias("id")))
    sums = settle(base.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    wanted = settle(targets(sums.select("key", "size")))
    sources = sums.count()

    def by_source(frame: DataFrame, table: DataFrame) -> DataFrame:
        if sources <= FEW_SOURCES:
            return frame.join(F.broadcast(table), "key")
        return salted_join(frame, table, ["key"], plain_rows=0)

    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    floor = F.floor(ratio + EPS)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio - floor))
    parts = wanted.select("key", floor.alias("floor"), share.cast("double").alias("p"))
    light = numbered(base.select("id", "key", "size", F.xxhash64("row").alias("h")), ["key", "h", "id"])
    now = by_source(light, parts).select("id", "key", "number", "size", "floor", "p")
    schema = now.schema
    decided, last, width = [], False, BLOCK
    while not last:
        group = F.floor(F.col("number") / width)
        blocks = now.select("key", group.alias("block")).distinct().groupBy("key").count().agg(F.max("count")).first()[0] or 1
        last = blocks == 1

        def fly(frame: pd.DataFrame, last: bool = last) -> pd.DataFrame:
            frame = frame.sort_values("number", kind="stable")
            return frame.assign(p=flight(frame["p"].to_numpy(), frame["size"].to_numpy(), last, seed))

        flown = settle(now.withColumn("block", group).groupBy("key", "block").applyInPandas(lambda f: fly(f).drop(columns="block"), schema))
        inside = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(flown.where(~inside))
        now, width = flown.where(inside), width * BLOCK // 4
    copies = decided[0]
    for more in decided[1:]:
        copies = copies.unionByName(more)
    counted = copies.select("id", (F.col("floor") + F.col("p").cast("bigint")).alias("copies"))
    return by_source(base.join(counted, "id"), wanted).select("row", "size", "source_size", "target", "copies")


def words(text: str = "text") -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


# Decisions on so many documents (two numbers each) are broadcast to the texts; more meet them by key.
FEW = 400_000


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every document as many times as it is taken, in the columns of `docs`.

    Texts take no part in the sampling: rows go by a hash of all their columns. Rows equal in all columns share their hash
    and are interchangeable; together they give as many rows as they are taken.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    light = docs.select(F.xxhash64(whole).alias("h"), F.col(f"`{source}`").alias("source"), words(text).alias("size"))
    taken = mix(light, F.col("size"), "source").groupBy("row.h").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = settle(taken.where("copies > 0"))
    rows = docs.select(whole.alias("row"), F.xxhash64(whole).alias("h"))

    def met(some: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(some) if some.count() <= FEW else some, "h")

    alone = met(taken.where("rows = 1").select("h", "copies")).select("row", "copies")
    equal = met(taken.where("rows > 1").select("h", "copies")).dropDuplicates(["h"]).select("row", "copies")
    every = alone.unionByName(equal).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return every.select("row.*")
