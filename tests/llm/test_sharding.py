import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import sharding
from metricloom.llm.queries import QUERIES


@pytest.mark.parametrize("rows", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_and_inverse(rows):
    numbers = np.arange(rows)
    placed = sharding.place_of(numbers, rows, seed=9)
    assert sorted(placed.tolist()) == numbers.tolist()
    assert (sharding.row_at(placed, rows, seed=9) == numbers).all()
    if rows > 100:
        assert (placed != sharding.place_of(numbers, rows, seed=8)).any()
        assert abs(np.corrcoef(numbers, placed)[0, 1]) < 0.1


def test_shards_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_sharding"](spark, sf).toPandas()
    again = QUERIES["op7_sharding"](spark, sf).toPandas()
    key = ["doc_id", "text_crc32", "size"]
    assert got.sort_values(key).reset_index(drop=True).drop(columns="grown_shard").equals(again.sort_values(key).reset_index(drop=True).drop(columns="grown_shard"))
    sizes = got.groupby("shard").slot.agg(["count", "min", "max"])
    assert len(sizes) == 24 and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all()
    import zlib

    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in got.itertuples():
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) or r.size == len(raw) + 8


def test_places_are_computable(spark):
    docs = spark.range(1000).select((F.col("id") * 3).alias("doc_id"))
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs, ["doc_id"], 7, seed=4).collect()}
    number = 123
    place = int(sharding.place_of([number], 1000, 4)[0])
    assert got[number * 3] == (place % 7, place // 7)


def test_awkward_rows(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (2, "b")] * 10
    docs = spark.createDataFrame(rows, "doc_id long, row string").withColumn("number", F.lit(1)).withColumn("slot", F.lit("old"))
    got = sharding.shards(docs, ["doc_id", "row"], 4).toPandas()
    assert sorted(got.groupby("shard").size()) == [12, 12, 13, 13]
    assert set(got.columns) == {"doc_id", "row", "number", "shard", "slot"}
    assert sharding.shards(docs.limit(0), ["doc_id"], 4).count() == 0
