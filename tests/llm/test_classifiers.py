"""Toxicity, language and quality: held-out accuracy, and defined results for awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import language, quality, sample, toxicity
from metricloom.llm.queries import QUERIES
from metricloom.llm.text import Flat, labelled, segment_sums

SF = "/root/testdata/sf0.01"
AWKWARD = "doc_id long, text string, row string, score string, key string, label string"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [
        (1, None, "a", "b", "c", None), (2, "", "a", None, "c", "x"), (None, "some words", None, None, None, None),
        (3, "same text", "a", "b", "c", "d"), (3, "same text", "a", "b", "c", "d"), (4, "12 34 !!", "a", "b", "c", "d"),
        (5, "long words of text " * 80_000, "a", "b", "c", "d"), (6, "\u0000퟿ é ß Σ ΑΣ \U0001f600", "a", "b", "c", "d"),
    ]
    return spark.createDataFrame(rows, AWKWARD)


def held_out(spark, name, labels):
    got = QUERIES[name](spark, SF).where("held_out").toPandas()
    known = spark.read.parquet(f"{SF}/{labels}.parquet").toPandas()
    return got.merge(known, on="doc_id", suffixes=("", "_known"))


def test_held_out_rule(spark):
    import zlib

    docs = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r[0] for r in docs.where(labelled(docs)[0]).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}


@pytest.mark.parametrize(("rows", "many"), [(60, 30_000), (60, 45), (4, 30_000)])
def test_sample_takes_the_first_hashes_of_each_label(spark, rows, many):
    """One label holds nearly all rows; labels beyond rows / 20 take no part."""
    docs = spark.range(many).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    label = F.when(F.col("doc_id") < 40, "rare").when(F.col("doc_id") == 41, "single").otherwise("hot")
    labels = docs.select("doc_id", label.alias("kind"))
    got = sample.trained(docs, labels, "doc_id", F.col("kind"), rows, 10**6, "text", lambda texts, kinds: sorted(zip(kinds, texts)))
    known = labels.select("kind", "doc_id", F.xxhash64("doc_id").alias("h")).toPandas().sort_values("h")
    frequent = known.groupby("kind").size().reset_index(name="n").sort_values(["n", "kind"], ascending=[False, True])
    kinds = frequent.kind[: max(1, rows // 20)]
    want = [(k, f"text {i}") for k in kinds for i in known[known.kind == k].doc_id[: max(1, rows // len(kinds))]]
    assert got == sorted(want)


def test_language_held_out(spark):
    got = held_out(spark, "op2_language_id", "documents")
    assert (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_quality_held_out(spark):
    got = held_out(spark, "op8_quality", "labels")
    assert (got.predicted == got.quality).mean() > 0.97
    assert (got.predicted == (got.score >= 0.3)).all()


def test_toxicity_finds_unseen_spellings():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 8))) for _ in range(400)]
    stems = ["zwagork", "brixplof"]

    def text(bad):
        words = list(rng.choice(plain, 120))
        for b in bad:
            words[rng.integers(0, 120)] = b
        return " ".join(words)

    seen = [stems[i % 2] + ending for i, ending in enumerate(["", "s", "a", "en", "ist", "o", "ly", "um"])]
    texts = [text(rng.choice(seen, 2)) for _ in range(150)] + [text([]) for _ in range(150)]
    model = toxicity.train(texts, [1] * 150 + [0] * 150)
    hidden = [text(["zwagorkqq", "brixplofff"]) for _ in range(40)]
    clean = [text([]) for _ in range(40)]
    assert (model.margins(hidden) > 0).mean() > 0.95
    assert (model.margins(clean) > 0).mean() < 0.05
    assert model.margins([hidden[0] + " " + " ".join(clean)])[0] > 0  # not excused by length


def test_toxicity_query_contract(spark):
    got = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


def test_awkward_rows(spark, awkward):
    model = language.train(["the and of that", "der die das und"] * 60, ["en", "de"] * 60)
    got = language.predict(awkward, model, awkward.columns).toPandas()
    by = {(r["doc_id"], r["text"]): (p, s) for r, p, s in zip(got.row, got.lang_pred, got.score)}
    assert by[(1, None)] == by[(2, "")] == by[(4, "12 34 !!")] == ("und", 0.0)
    assert len(got) == awkward.count()
    assert set(got.row[0].asDict()) == set(awkward.columns)
    for model, score in (
        (toxicity.train(["bad worse", "good fine"] * 40, [1, 0] * 40), toxicity.score),
        (quality.train(["bad!! worse!!", "good fine"] * 40, [0, 1] * 40), quality.score),
    ):
        made = score(awkward, model, ["doc_id", "text"]).toPandas()
        assert len(made) == awkward.count() and made.score.between(0, 1).all()
        same = made[made.row.map(lambda r: r["doc_id"] == 3)]
        assert same.score.nunique() == 1
        empty = made[made.row.map(lambda r: not r["text"])]
        assert empty.score.nunique() == 1


def test_without_examples(spark, awkward):
    nothing = awkward.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for docs in (awkward, nothing):
        assert toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).count() == docs.count()
        assert quality.score(docs, quality.fit(docs, labels), ["doc_id"]).count() == docs.count()
        found = language.predict(docs, language.fit(docs.withColumn("lang", F.lit(None))), ["doc_id"])
        assert found.where("lang_pred <> 'und'").count() == 0


def test_words_and_shingles():
    flat = Flat(["a b", "", " a  b\tc\nd e f", "a b"])
    words = flat.words()
    assert words.counts.tolist() == [2, 0, 6, 2]
    h = words.hash
    assert h[0] == h[2] == h[8] and h[0] != h[1]
    shingles, counts = words.shingles(5)
    assert counts.tolist() == [1, 0, 2, 1] and shingles[0] == shingles[3]
    assert segment_sums(np.arange(4.0), np.array([1, 0, 3])).tolist() == [0, 0, 6]


def test_language_is_sparse_and_calibrated():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list(words), 30)) for words in (("the", "of", "and"), ("der", "und", "die")) for _ in range(100)]
    model = language.train(texts, ["en"] * 100 + ["de"] * 100)
    assert 0 < (model.weights != 0).mean() < 0.01
    assert model.temperature > 0
    assert model.predict(["the of", "und der", "!"])[0] == ["en", "de", "und"]
