import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import jaccard
from metricloom.llm.components import components
from metricloom.llm.queries import QUERIES


def words(text):
    return tuple(re.findall(r"[^ \t\n\r\f\v]+", (text or "").lower()))


def shingles(text, n=5):
    w = words(text)
    return {w[i : i + n] for i in range(max(1, len(w) - n + 1))} if w else set()


def expected(rows, threshold=0.8):
    """id -> (class id, copies, links, linked classes, group id), by comparing all pairs of texts."""
    texts = {}
    for i, t in rows:
        texts.setdefault(words(t) or ("alone", i), []).append(i)
    keys = list(texts)
    head = [min(texts[k]) for k in keys]
    sets = [shingles(" ".join(k)) if k[0] != "alone" else set() for k in keys]
    linked = [[] for _ in keys]
    group = list(range(len(keys)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                linked[a].append(b)
                linked[b].append(a)
                x, y = root(a), root(b)
                group[x] = y
    least = {}
    for a in range(len(keys)):
        least[root(a)] = min(least.get(root(a), head[a]), head[a])
    out = {}
    for a, k in enumerate(keys):
        n = len(texts[k])
        for i in texts[k]:
            out[i] = (head[a], n, n - 1 + sum(len(texts[keys[b]]) for b in linked[a]), len(linked[a]), least[root(a)])
    return out


def found(frame):
    return {r.row.doc_id: (r.class_id, r.copies, r.links, r.linked_classes, r.group_id) for r in frame.collect()}


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.copies, r.links, r.linked_classes, r.group_id) for r in QUERIES["op6_jaccard_join"](spark, sf).collect()}
    assert got == expected(rows)


@pytest.fixture(scope="module")
def family():
    """One large group of near copies with all similarities around the threshold, exact copies and others."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    rows = []
    for i in range(160):
        w = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 6))):
            w[at] = f"x{rng.integers(0, 9999)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i % 7][1].upper().replace(" ", "\n ", 3)) for i in range(20)]
    rows += [(300 + i, " ".join(f"y{j}" for j in rng.integers(0, 900, 40))) for i in range(40)]
    return rows


def test_large_group_in_blocks(spark, family, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 0)
    docs = spark.createDataFrame(family, "doc_id long, text string")
    small = jaccard.Settings(block=16, weight=3000)
    got = found(jaccard.join(docs, s=small))
    monkeypatch.undo()
    assert got == expected(family) == found(jaccard.join(docs))


def test_pipeline_stage_keeps_one_of_each_group(spark, family):
    docs = spark.createDataFrame([*family, (400, None), (401, ""), (402, " \t"), (0, family[0][1])], "doc_id long, text string").withColumn("key", F.lit("k"))
    kept = jaccard.distinct_documents(docs)
    assert kept.columns == docs.columns
    groups = Counter(g for *_, g in expected(family).values())
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*groups, 400, 401, 402])


def test_awkward_rows(spark):
    long = " ".join(f"t{i % 5000}" for i in range(200_000))
    rows = [(None, "a b"), (1, None), (2, ""), (3, None), (4, "A  b"), (5, "a b c"), (6, long), (7, long), (7, long), (8, "one two three four five"), (9, "ONE two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "sig": F.lit(2), "id": F.lit(3), "links": F.lit("x")})
    got = {(r.row.doc_id): (r.class_id, r.copies, r.links, r.group_id, r.has_words) for r in jaccard.join(docs).collect()}
    assert got[None] == got[4] == (None, 2, 1, None, True)
    assert got[1] == (1, 1, 0, 1, False) and got[2] == (2, 1, 0, 2, False) and got[5] == (5, 1, 0, 5, True)
    assert got[6] == got[7] == (6, 3, 2, 6, True) and got[8] == got[9] == (8, 2, 1, 8, True)
    assert jaccard.join(docs.limit(0)).count() == 0 and jaccard.distinct_documents(docs.limit(0)).count() == 0


def test_pruning_bounds():
    s = jaccard.Settings()
    for n, m in jaccard.least_matches(s):
        # By integration over the posterior of a uniform prior.
        x = (np.arange(200_000) + 0.5) / 200_000
        for k, dropped in ((m - 1, True), (m, False)):
            if k >= 0:
                density = x**k * (1 - x) ** (n - k)
                assert (density[x >= s.threshold].sum() / density.sum() < s.tolerance) == dropped


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_clashing_names_and_agreeing_polynomials(spark):
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other), (3, f"{one}\t"), (4, "x y"), (5, "x\ty"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("__tid", "tid", "kept", "key", "row", "copies")})
    got = {r.row.doc_id: (r.class_id, r.copies, r.links) for r in jaccard.join(docs).collect()}
    assert got == {1: (1, 2, 1), 3: (1, 2, 1), 2: (2, 1, 0), 4: (4, 2, 1), 5: (4, 2, 1), 6: (6, 1, 0)}
