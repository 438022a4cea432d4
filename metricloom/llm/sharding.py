"""Sharding by a keyed permutation of the row numbers.

A Feistel network permutes the smallest even-bit domain that holds all row numbers; numbers that it sends beyond the table
are sent on (cycle walking), which leaves a permutation of exactly the rows. The permuted place gives shard and slot by
division, so where a row goes, and which row a slot holds, can be computed without any table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .rows import numbered
from .text import importable, mixed

ROUNDS = 6


def _keys(seed: int) -> np.ndarray:
    return mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))


def _half(rows: int) -> int:
    return max(1, (max(rows - 1, 1).bit_length() + 1) // 2)


def _network(values: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = values >> bits, values & mask
    for key in keys:
        left, right = right, left ^ (mixed(right + key) & mask)
    return (right << bits) | left  # halves swapped once more: the same network with its keys reversed undoes it


def _walk(values: np.ndarray, rows: int, keys: np.ndarray) -> np.ndarray:
    out = _network(values.astype(np.uint64), _half(rows), keys)
    while (beyond := out >= rows).any():
        out[beyond] = _network(out[beyond], _half(rows), keys)
    return out.astype(np.int64)


def place_of(numbers: np.ndarray, rows: int, seed: int = 0) -> np.ndarray:
    """Place in the shuffled order of each row number below `rows`."""
    return _walk(np.asarray(numbers), rows, _keys(seed))


def row_at(places: np.ndarray, rows: int, seed: int = 0) -> np.ndarray:
    """Row number at each place: the inverse of `place_of`."""
    return _walk(np.asarray(places), rows, _keys(seed)[::-1])


def shards(docs: DataFrame, order: list[str], n: int, seed: int = 0) -> DataFrame:
    """All columns of `docs`, `shard` from 0 to n - 1 and `slot`, gapless from 0 in every shard.

    Rows are numbered in the order of the columns `order` (nulls first); rows equal in these are interchangeable, so the
    result doesn't depend on partitions. Shards differ by one row at most. An empty table stays empty. Columns named shard
    or slot are replaced.
    """
    importable(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    made = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *_ordered(order)), _names(order), "number")
    rows = made.count()

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(place_of(numbers.to_numpy(), rows, seed))

    placed = made.withColumn("place", place("number"))
    return placed.select("row.*", (F.col("place") % n).cast("int").alias("shard"), F.expr(f"place div {n}").alias("slot"))


def _names(order: list[str]) -> list[str]:
    return [f"by{i}" for i in range(len(order))]


def _ordered(order: list[str]) -> list:
    return [F.col(f"`{c}`").alias(name) for c, name in zip(order, _names(order))]
