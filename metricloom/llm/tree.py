"""Partial results of many tasks, merged in rounds."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.settle import settle
from .text import importable

FAN = 16


def tree_merged(parts: DataFrame, add: Callable[[object, object], object], nothing: object) -> object:
    """The pickled values of the column `part`, added up.

    Each round deals the values to a sixteenth as many tasks, so no task and not the driver adds more than `FAN` of them;
    the driver gets the one that is left. Rounds are written: a lost executor repeats its part of one round.
    """
    importable(parts.sparkSession)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0):
                one = pickle.loads(value.as_py())
                total = one if total is None else add(total, one)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    made = settle(parts.select("part"))
    left = made.count()
    while left > 1:
        made = settle(made.repartition(math.ceil(left / FAN)).mapInArrow(merge, "part binary"))
        left = made.count()
    last = made.first()
    return nothing if last is None else pickle.loads(last[0])
