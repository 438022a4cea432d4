import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import mixing
from metricloom.llm.queries import QUERIES
from metricloom.llm.rows import numbered


def wanted(sizes):
    """Targets by resharing the excess until no source is above three times its size."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return share | capped
        capped |= {s: 3 * sizes[s] for s in above}


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 5, "c": 10, "d": 20, None: 7}, {"é": 0, "z": 50, "": 3}, {"a": 9}, {str(i): 1 + i * i % 97 for i in range(60)}],
)
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(("1" if s is None else "0" + s), n) for s, n in sizes.items()], "key string, size long")
    got = {r.key: r.target for r in mixing.targets(frame).collect()}
    for s, t in wanted(sizes).items():
        assert got["1" if s is None else "0" + s] == pytest.approx(t)


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_totals(seed):
    rng = np.random.default_rng(seed)
    p, size = rng.random(400), rng.integers(0, 900, 400)
    flown = mixing.flight(p, size, land=False)
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert abs(flown.sum() - p.sum()) < 1 and (flown * size).sum() == pytest.approx((p * size).sum())
    landed = mixing.flight(p, size, land=True)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) <= np.sort(size)[20]


def test_flight_of_equal_and_empty_sizes():
    for size in (np.full(50, 7), np.zeros(50, int), np.array([5]), np.array([], int)):
        landed = mixing.flight(np.full(len(size), 0.3), size, land=True)
        assert set(landed) <= {0.0, 1.0} and abs(landed.sum() - 0.3 * len(size)) <= 1


def test_flight_expectation():
    size = np.array([50, 40, 3, 2, 2, 1])
    p = np.array([0.2, 0.7, 0.5, 0.5, 0.4, 0.9])
    rows = [mixing.flight(p, size, True, seed) for seed in range(3000)]
    assert np.abs(np.mean(rows, 0) - p).max() < 0.05


@pytest.mark.parametrize("p", [0.05, 0.46, 0.9])
def test_every_document_has_the_same_share(p):
    size = np.concatenate([[20_020, 6_005, 3_000], np.random.default_rng(1).integers(1, 400, 120)])
    rows = np.array([mixing.flight(np.full(len(size), p), size, True, seed) for seed in range(1500)])
    assert np.abs(rows.mean(0) - p).max() < 5 * np.sqrt(p * (1 - p) / 1500)
    # The large ones make way, or are made way for, where the others are enough for it.
    off = np.abs(rows @ size - p * size.sum())
    assert off.max() <= 20_020
    if p == 0.46:
        assert np.median(off) <= 40


def test_shares_of_a_mix(spark):
    rows = [(i, "w " * (5000 if i == 0 else 20 + i % 30), "a" if i % 3 else "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    taken = {i: [] for i in range(60)}
    for seed in range(8):
        for r in mixing.mix(docs, mixing.words(), "source", seed).collect():
            taken[r.row.doc_id].append(r.copies)
    assert len({tuple(t) for t in taken.values()}) > 2 and all(len(t) == 8 and max(t) <= 3 for t in taken.values())


def test_mix_of_documents(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    first = QUERIES["op5_mixing"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").toPandas()
    got = first.merge(docs, on="doc_id")
    for _, g in got.groupby("source", dropna=False):
        assert g["size"].sum() == g.source_size.iloc[0]
        # All have the same chance, so one document can be more than all a source is short of.
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(0.02 * g.target.iloc[0], g["size"].max())
    assert (got.taken <= 3 * got["size"]).all()
    again = QUERIES["op5_mixing"](spark, sf).toPandas()
    assert first.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    monkeypatch.setattr(mixing, "BLOCK", 16)  # several levels of blocks
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)  # sources joined by key
    small = QUERIES["op5_mixing"](spark, sf).toPandas().merge(docs, on="doc_id")
    for _, g in small.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(0.05 * g.target.iloc[0], g["size"].max())


def test_awkward_rows(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (None, None, "x"), (2, "", "x"), (3, "one two  three\n", "y"), (4, "w " * 300_000, "z"), (5, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"key": F.lit(1), "size": F.lit("q"), "copies": F.lit(0)})
    got = mixing.mix(docs, mixing.words(), "source").toPandas()
    assert sorted(got["size"]) == [0, 0, 0, 3, 3, 3, 300_000] and got.copies.between(0, 3).all()
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0), mixing.words(), "source").count() == 0


def test_numbered(spark):
    rows = [(None,), (5,), (5,), (5,), (1,)] * 40
    got = numbered(spark.createDataFrame(rows, "v long").repartition(7), ["v"]).toPandas().sort_values("number")
    assert got.number.tolist() == list(range(200))
    assert got.v.isna().tolist() == [True] * 40 + [False] * 160 and got.v.dropna().is_monotonic_increasing


def test_mixed_documents_are_the_mix(spark, monkeypatch):
    rows = [(i % 90, f"text {i % 90} " * (1 + i % 7), f"s{i % 3}") for i in range(300)] + [(None, None, None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = mixing.mix(docs, mixing.words(), "source").groupBy("row").agg(F.sum("copies").alias("n")).where("n > 0")
    want = sorted(((r.row.doc_id, r.row.text, r.row.source), r.n) for r in wanted.collect())
    for few in (mixing.FEW, 0):
        monkeypatch.setattr(mixing, "FEW", few)
        got = mixing.mixed_documents(docs).groupBy("doc_id", "text", "source").count().collect()
        totals = {}
        for r in got:
            totals[r.source] = totals.get(r.source, 0) + r["count"] * len((r.text or "").split())
        expected = {}
        for (_, text, source), n in want:
            expected[source] = expected.get(source, 0) + n * len((text or "").split())
        assert {s for s, n in totals.items() if n} == {s for s, n in expected.items() if n}
        for s, n in expected.items():
            assert abs(totals[s] - n) <= 40  # equal rows may be taken otherwise than single ones
