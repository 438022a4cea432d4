import hashlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from metricloom.llm import fingerprints as f
from metricloom.llm.queries import QUERIES


@lru_cache(None)
def hashed(word):
    return int(f.Flat([word], lower=False).hashes(np.array([0]), np.array([len(word)]))[0])


def passages(text):
    out = Counter()
    for line in text.split("\n"):
        words = re.findall(r"[^ \t\n\r\f\v]+", line)
        now = []
        for word in words:
            now.append(word)
            if hashed(word) % f.PASSAGE == 0 or len(now) == f.LONGEST:
                out[tuple(now)] += 1
                now = []
        if now:
            out[tuple(now)] += 1
    return out


def shared(a, b):
    a, b = passages(a), passages(b)
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 1.0


def check(frame, texts):
    """`texts`: (id, text) in the order of the table."""
    prints = {}
    for k, ((i, t), r) in enumerate(zip(texts, frame.itertuples())):
        following = texts[(k + 1) % len(texts)][1]
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(shared(t, changed)) and r.near_next == pytest.approx(shared(t, following))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op4_fingerprints"](spark, sf).toPandas().sort_values("doc_id")
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert got.doc_id.tolist() == [i for i, _ in rows]
    check(got, rows)


def test_awkward_rows(spark):
    rows = [(9, "é\U0001f600 ab\n" * 50), (3, None), (4, ""), (5, "x"), (6, "same words here now and then"), (7, "same words here now and then"), (8, "a b c d\n" * 30_000)]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, row string, range int").repartition(3)
    got = f.fingerprints(docs, docs.columns).select("row.doc_id", *f.SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", "))
    check(got.toPandas().sort_values("doc_id"), sorted((i, t or "") for i, t in rows))
    assert f.fingerprints(docs.limit(0), ["doc_id"]).count() == 0
    one = f.fingerprints(docs.where("doc_id = 6"), ["doc_id"]).collect()[0]
    assert one.near_next == 1.0


def test_null_and_repeated_ids(spark):
    rows = [(None, "n one two"), (None, "n one two"), (1, "a"), (1, "b"), (1, "b")] * 3
    got = f.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]).toPandas()
    assert len(got) == 15
    assert got.groupby(got.row.map(lambda r: r["text"])).fingerprint.nunique().tolist() == [1, 1, 1]
    assert (got.near_next == 1.0).sum() >= 9  # the next of most rows is their repetition


def test_subtract_and_peel_fingerprints():
    shared = [f"paragraph {i} of the text" for i in range(300)]
    a, b = f.Sets(["\n".join([*shared, "only in the first one"]), "\n".join(["x new line", *shared])]), None
    prints = [s for s in a.sketch(np.arange(2), f.CELLS).texts(a.counts, a.whole)]
    (x, n), (y, m) = f.parsed(prints[0]), f.parsed(prints[1])
    keys, _, sign, whole = (x - y).peel()
    assert n == m + 1 or n == m + 0 or n == m - 1
    assert whole.all()
    own = set(a.keys[: a.counts[0]].tolist()), set(a.keys[a.counts[0] :].tolist())
    assert set(keys[sign > 0].tolist()) == own[0] - own[1] and set(keys[sign < 0].tolist()) == own[1] - own[0]


def test_too_small_a_sketch_fails_and_grows():
    a, b = f.Sets([" ".join(f"w{i}" for i in range(4000))]), f.Sets([" ".join(f"v{i}" for i in range(4000))])
    zero = np.zeros(1, int)
    assert not (a.sketch(zero, f.CELLS) - b.sketch(zero, f.CELLS)).peel()[3].any()
    assert f.likeness(a, zero, b, zero).tolist() == [0.0] and f.likeness(a, zero, a, zero).tolist() == [1.0]


def test_an_inserted_word_changes_few_passages():
    words = [f"w{i}" for i in range(2000)]
    before, after = f.Sets([" ".join(words)]), f.Sets([" ".join(["new", *words])])
    zero = np.zeros(1, int)
    assert f.likeness(before, zero, after, zero)[0] > 0.99


def test_words_whose_polynomials_agree():
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    a, b = f.Sets([one]), f.Sets([other])
    zero = np.zeros(1, int)
    assert f.likeness(a, zero, b, zero)[0] == 0.0 and a.whole[0] != b.whole[0]


@pytest.mark.parametrize("hot", [None, 7])
def test_an_id_of_many_rows_is_split(spark, hot):
    rows = [(i, f"text number {i}") for i in range(100)] + [(hot, f"hot text {i} {i * i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = f.fingerprints(docs, ["doc_id", "text"]).collect()
    texts = {r.row.text: r for r in got}
    assert len(got) == 500 and len(texts) == 500
    # every text is edited with the next one's letters, so each one but its own gives them once
    follows = {t: [u for u in texts if hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest() == r.edited_sha256] for t, r in texts.items()}
    assert all(follows.values())
    ids = dict((t, i) for i, t in rows)
    for t, after in follows.items():
        i = ids[t]
        if i is not None and i != hot and i != (hot or 0) - 1 and i != 99:
            assert f"text number {i + 1}" in after
