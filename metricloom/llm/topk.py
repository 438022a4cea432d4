"""Exact top-k by inner product: branch and bound over dimension blocks.

Vectors lie in vertical layout, one row per dimension. Scores of a block of queries against a block of candidates are
accumulated some dimensions at a time; after each step the product of the remaining masses (the norms of the dimensions that
are left) bounds what a pair can still gain, and pairs that cannot reach the query's k-th score so far are dropped and the
survivors compacted. Blocks of queries meet blocks of candidates in a grid of tasks, each keeps k rows per query, and the
best k of those are ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .rows import numbered
from .text import importable

# Rows of the candidate blocks, and of the blocks of rows among which the queries of a block are.
CANDIDATES, QUERIES = 4096, 40_960
# Dimensions a step, queries worked on at once, candidates scored in full before anything is dropped.
DIMENSIONS, TOGETHER, SEED = 16, 64, 512
# Share of living pairs from which on they are listed one by one.
SPARSE = 0.1


def integers(vector: Column) -> Column:
    """floor(64 x) of every component; null for vectors that are null or hold null or non-finite components."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.coalesce(~bad, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * 64).cast("bigint")))


def exact(x: np.ndarray, y: np.ndarray) -> type:
    """A type in which all inner products of rows of x and y are exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(x.shape[1], 1)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def best(queries: np.ndarray, own: np.ndarray, candidates: np.ndarray, numbers: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """For each query the k best of the candidates but itself: positions of query and candidate, and the score."""
    kind = exact(queries, candidates)
    dims = queries.shape[1]
    steps = [slice(d, min(d + DIMENSIONS, dims)) for d in range(0, dims, DIMENSIONS)]
    vertical = np.ascontiguousarray(candidates.T, kind)
    mass = lambda m: [np.sqrt((m[:, s.stop :].astype(np.float64) ** 2).sum(1)) for s in steps]
    left = mass(candidates)
    got: list[tuple] = []
    for at in range(0, len(queries), TOGETHER):
        q, mine = queries[at : at + TOGETHER].astype(kind), own[at : at + TOGETHER]
        rest = mass(queries[at : at + TOGETHER])
        full = q @ vertical[:, :SEED]
        known = np.where(mine[:, None] == numbers[None, :SEED], np.nan, full.astype(np.float64))
        enough = (~np.isnan(known)).sum(1) >= k
        limit = np.full(len(q), -np.inf)
        if enough.any():
            limit[enough] = -np.partition(np.nan_to_num(-known[enough], nan=np.inf), k - 1, axis=1)[:, k - 1]
        a, b = np.nonzero(known >= limit[:, None])
        pairs = [(a, b, full[a, b])]
        if vertical.shape[1] > SEED:
            pairs.append(_rest(q, vertical, rest, left, steps, limit, mine, numbers))
        a, b, score = (np.concatenate(x) for x in zip(*pairs))
        score = score.astype(np.int64)
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        got.append((a[keep] + at, b[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3


def _rest(q, vertical, rest, left, steps, limit, mine, numbers) -> tuple:
    """Pairs beyond the seeds that may reach the limits, with their whole scores."""
    columns = np.arange(SEED, vertical.shape[1])
    partial, listed = np.zeros((len(q), len(columns)), q.dtype), None
    for i, s in enumerate(steps):
        if listed is None:
            partial += q[:, s] @ vertical[s, columns] if len(columns) < vertical.shape[1] - SEED else q[:, s] @ vertical[s, SEED:]
            room = rest[i][:, None] * left[i][None, columns]
            alive = partial + room * (1 + 1e-9) + 1e-6 >= limit[:, None]
            if alive.mean() < SPARSE:
                a, b = np.nonzero(alive)
                listed = a, columns[b], partial[a, b]
            elif not (some := alive.any(0)).all():
                columns, partial = columns[some], partial[:, some]
        else:
            a, b, score = listed
            score = score + np.einsum("ij,ij->i", q[a, s], vertical[s, b].T)
            keep = score + rest[i][a] * left[i][b] * (1 + 1e-9) + 1e-6 >= limit[a]
            listed = a[keep], b[keep], score[keep]
    if listed is None:
        a, b = np.nonzero(partial >= limit[:, None])
        listed = a, columns[b], partial[a, b]
    a, b, score = listed
    other = (mine[a] != numbers[b]) & (score >= limit[a])
    return a[other], b[other], score[other]


def top(vectors: DataFrame, id_: str, vector: str, query: Column, k: int) -> DataFrame:
    """`query_id`, `rank` from 1, `vec_id`, `score` of the k highest integer inner products of each query row.

    Candidates are all rows but the query's own; a repeated row is a candidate of the other. Ties go to the smaller id
    (null ids last). Vectors without an integer form, and null queries, take no part; vectors of another length than the
    query's are no candidates. Sums are exact below 2**63. An empty table gives no rows; other columns are not read.
    """
    importable(vectors.sparkSession)
    frame = vectors.select(
        F.col(f"`{id_}`").cast("bigint").alias("id"), integers(F.col(f"`{vector}`")).alias("v"), F.coalesce(query, F.lit(False)).alias("asks")
    ).where("v IS NOT NULL")
    rows = numbered(frame.withColumn("h", F.xxhash64("v")), ["id", "h"])
    n = rows.count()
    across, down = max(1, -(-n // CANDIDATES)), max(1, -(-n // QUERIES))
    size = F.size("v")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = rows.where("asks").select(*[F.col(x).alias(f"own_{x}") for x in ("id", "number", "v")], size.alias("d"), F.floor(F.col("number") / QUERIES).cast("int").alias("q"), every(across).alias("c"))
    stored = rows.select(*[F.col(x).alias(f"its_{x}") for x in ("id", "number", "v")], size.alias("d"), every(down).alias("q"), F.floor(F.col("number") / CANDIDATES).cast("int").alias("c"))
    result = pa.schema([("own", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return result.empty_table()
        grid = lambda t: t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        ids = right.column("its_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        own, numbers = left.column("own_number").to_numpy(), right.column("its_number").to_numpy()
        a, b, score = best(grid(left), own, grid(right), numbers, ids, k)
        return pa.table([pa.array(own[a]), left.column("own_id").take(a), right.column("its_id").take(b), pa.array(score)], schema=result)

    keys = ["d", "q", "c"]
    found = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(cell, "own long, query_id long, vec_id long, score long")
    order = W.partitionBy("own").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
