import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import topk
from metricloom.llm.queries import ORACLE, QUERIES


def brute(rows, asks, k):
    known = [(n, i, [math.floor(64 * float(x)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in known:
        if asks(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in known if m != n and len(v) == len(w))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = sorted(map(tuple, con.execute(ORACLE["op10_topk"]).fetchall()))
    assert sorted(map(tuple, QUERIES["op10_topk"](spark, "/root/testdata/sf0.01").collect())) == want


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6])
def test_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CANDIDATES", 700)
    monkeypatch.setattr(topk, "QUERIES", 900)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 40))
    rows = [(int(i), [float(x) for x in (centres[i % 5] + 0.2 * rng.normal(size=40)) * scale]) for i in range(1500)]
    rows += [(i, v) for i, v in rows[:60]] + [(2000 + i, rows[7][1]) for i in range(25)]  # repeated rows, ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top(frame, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 10)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0, 10)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (1, [0.5, -0.51]), (2, [1.0, 2.0, 3.0]), (100, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "id": F.lit("x"), "rank": F.lit(0)})
    got = topk.top(frame, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 64 * 32 + 128 * -33)]
    assert topk.top(frame.limit(0), "vec_id", "embedding", F.lit(True), 5).count() == 0
    nobody = topk.top(frame, "vec_id", "embedding", F.lit(None).cast("boolean"), 5)
    assert nobody.count() == 0
