"""Every stage works on all its predecessor kept, and returns the columns of documents."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers

from .test_jaccard import expected

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    before = docs.toPandas()
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.settle(stage(spark, docs, SF))
        assert docs.columns == columns
        seen[name] = docs.toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_duplicates", "source_mix", "best_fit_packing"]

    known = seen["language_id"]
    assert len(known) > 0.98 * len(before) and not known.text.isna().any()
    good = seen["quality_classifier"]
    held = [i for i in known.doc_id if i in labels.index and zlib.crc32(str(i).encode()) % 5 == 0]
    kept = set(good.doc_id)
    assert np.mean([(i in kept) == (labels.quality[i] == 1) for i in held]) > 0.97
    alone = seen["near_duplicates"]
    groups = {g for *_, g in expected(list(zip(good.doc_id, good.text))).values()}
    assert sorted(alone.doc_id) == sorted(groups)
    mix = seen["source_mix"]
    assert set(mix.doc_id) <= set(alone.doc_id) and mix.groupby("doc_id").size().max() <= 3

    last = corpus_pipeline.STAGES[4][1](spark, docs, SF).toPandas()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r.doc_id: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in alone.itertuples()}
    assert last.length.sum() == sum(tokens[i] for i in mix.doc_id)
    assert last.groupby("sequence_id").length.sum().max() <= 2048
    assert last.sequence_id.nunique() <= 1.02 * last.length.sum() / 2048 + 2


def test_awkward_documents_go_through(spark):
    """Nulls in any column, empty and repeated texts; texts without a letter are rejected, the others are judged."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "12", None, None, None), (3, "word " * 50_000, "en", "s", 1)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-9 if r[0] is None else -r[0], *r[1:]) for r in rows], docs.schema))
    known = corpus_pipeline.settle(corpus_pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.001"))
    assert {r.doc_id for r in known.where("doc_id < 0").collect()} <= {-3}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0
