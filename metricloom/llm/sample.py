"""Models trained on bounded samples of labelled documents."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .text import give_back, importable


def trained(
    docs: DataFrame, labels: DataFrame, id_: str, label: Column, rows: int, chars: int, text: str, train: Callable[[list, list], object]
):
    """What `train` makes of at most `rows` labelled texts with about `chars` characters in all.

    Rows are taken in the order of a hash of their id, evenly from the different labels, up to the first text that exceeds
    `chars`; null ids, texts and labels take no part, and of texts with one id one is taken. Only ids are shuffled to find
    them, and of a frequent label only those whose hash can be among the first: labels are counted, hashes are even, so the
    first n lie below a share of the hashes that holds n rows and six deviations more (beyond that the sample would be
    smaller). The texts are fetched with a broadcast of at most `rows` ids. The bounded sample is one task's input; the
    driver gets the model.
    """
    importable(docs.sparkSession)
    ids = docs.select(F.col(f"`{id_}`").alias("id")).where("id IS NOT NULL").distinct()
    named = labels.select(F.col(f"`{id_}`").alias("id"), label.alias("label")).where("label IS NOT NULL").dropDuplicates()
    known = named.join(ids, "id")
    counts = known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max(1, rows // 20))
    kinds = {r[0]: r[1] for r in counts.collect()}
    order = [F.xxhash64("id"), F.col("id"), F.col("label")]
    if not kinds:
        return train([], [])
    # Labels too many to give each twenty rows: the frequent ones.
    n = max(1, rows // len(kinds))
    likely = n + 6 * math.sqrt(n) + 50
    shares = F.create_map(*[F.lit(v) for kind, count in kinds.items() for v in (kind, min(1.0, likely / count))])
    near = known.where(F.xxhash64("id") / F.lit(2.0**64) + 0.5 <= F.try_element_at(shares, F.col("label")))  # other labels have no share
    place = F.row_number().over(W.partitionBy("label").orderBy(*order))
    chosen = near.withColumn("place", place).where(F.col("place") <= n).drop("place")
    texts = docs.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")  # a task sends one text of an id
    taken = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(first).select("id", "label", "first.text")
    taken = taken.repartition(1).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known, total = [], [], 0
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                total += len(t)
                if not found or total <= chars:
                    found.append(t)
                    known.append(y)
        model = pickle.dumps(train(found, known))
        del found, known
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    return pickle.loads(taken.mapInArrow(run, "model binary").first()[0])
