"""Aligned tokens against a plain version that encodes whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from metricloom.llm import alignment
from metricloom.llm.queries import QUERIES

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain(texts):
    """For every text: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    names = {i: t for t, i in a.get_vocab().items()}
    letters = {}
    extra = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + extra)] = byte
            extra += 1
    made = []
    for text in texts:
        groups = []
        if text:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = b.encode(text)
            bytes_a = [bytes(letters[c] for c in names[i]) for i in ids_a]
            pieces = [(b.is_byte(i), b.id_to_piece(i)) for i in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for is_byte, p in pieces]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                i = j = 0
                while i < len(ids_a):
                    one, other = [ids_a[i]], [ids_b[j]]
                    left, right = len(bytes_a[i]), len(bytes_b[j])
                    i, j = i + 1, j + 1
                    while left != right:
                        if left < right:
                            one.append(ids_a[i])
                            left, i = left + len(bytes_a[i]), i + 1
                        else:
                            other.append(ids_b[j])
                            right, j = right + len(bytes_b[j]), j + 1
                    groups.append((one, other))
        made.append(groups)
    pairs = Counter(p for groups in made for p in {(x, y) for one, other in groups for x in one for y in other})
    most = Counter()
    for (x, _), n in pairs.items():
        most[x] = max(most[x], n)
    out = []
    for groups in made:
        links = [pairs[x, y] - (0 if pairs[x, y] == most[x] else 0.5) for one, other in groups for x in one for y in other]
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, other)) for one, other in groups)
        best = sum(n == int(n) for n in links)
        total = sum(int(n + 0.5) for n in links)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), best, total, text))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def texts(n, seed):
    random.seed(seed)
    words = ["the", "naïve", "don't", "Straße", "हिन्दी", "中文字", "ab\ncd", "x\t", "1234", "...", "<|endoftext|>", "<s>", "<0x41>", "▁", "ﬁ", "á", " ", "😀👍", "e" * 40]
    out = [None, "", " ", "  ", "a ", " a", "a  b", "a \n b", "\n", "a▁b c", "the the the", "the the the", "\x00 z", "a　 b", "q" * 5000, "ab " * 4000 + "end  "]
    for _ in range(n):
        some = [random.choice(words) if random.random() < 0.7 else "".join(random.choices("abcdefg ,.é\n", k=random.randint(1, 9))) for _ in range(random.randint(1, 30))]
        out.append(random.choice([" ", " ", "  ", ""]).join(some))
    for _ in range(n):
        out.append("".join(chr(random.choice([*range(32, 127), *range(0xA0, 0x250), *range(0x900, 0xA00), 0x2028, 0x85, 0x2581, 0x1F600])) for _ in range(random.randint(1, 60))))
    return out


def found(frame):
    return {r["row"]["doc_id"]: tuple(r[c] for c in COLUMNS) for r in frame.collect()}


@pytest.fixture(scope="module")
def corpus(spark):
    given = texts(150, 3)
    rows = [(i, t, f"x{i}") for i, t in enumerate(given)]
    return given, spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(5)


def test_equals_plain_version(corpus):
    given, docs = corpus
    assert found(alignment.aligned(docs, *PATHS, ["doc_id", "row"])) == dict(enumerate(plain(given)))


def test_passes_and_buckets(corpus, monkeypatch):
    given, docs = corpus
    for name, value in (("BUCKET", 100), ("SLICE", 2), ("FAN", 2), ("KNOWN", 200), ("WIDE", 3), ("BATCH", 7)):
        monkeypatch.setattr(alignment, name, value)
    assert found(alignment.aligned(docs, *PATHS, ["doc_id"], held=1000)) == dict(enumerate(plain(given)))


def test_whole_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_alignment"](spark, sf_dir).collect()}
    want = plain([d["text"] for d in docs])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert got == {d["doc_id"]: (*w[:6], digest(w[6])) for d, w in zip(docs, want)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(docs, *PATHS, ["doc_id"]).collect() == []


def test_texts_without_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a▁b"), (3, "a▁b")], "doc_id long, text string")
    rows = alignment.aligned(docs, *PATHS, ["doc_id"]).collect()
    assert len(rows) == 4 and {tuple(r[c] for c in COLUMNS) for r in rows} == {(0, 0, 0, 0, 0, 0, "")}


@pytest.mark.parametrize("n", [1, 2, 63, 1000, 20000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 50, n).astype(np.uint64))
    sizes, words = alignment.cascade(keys)
    places = alignment.PerfectHash([sizes], [words]).places(keys, np.zeros(len(keys), np.int64))
    assert sorted(places.tolist()) == list(range(len(keys)))


def test_unknown_pair_is_noticed():
    keys = np.arange(100, dtype=np.uint64)
    sizes, words = alignment.cascade(keys)
    made = alignment.PerfectHash([sizes], [words])
    by_place = np.empty_like(keys)
    by_place[made.places(keys, np.zeros(100, np.int64))] = keys
    table = alignment.Table("t", 1, np.zeros(1, np.int64), made, by_place, keys.astype(np.int64), np.zeros(1))
    assert (table.pairs[table.places(keys)] == keys).all()
    assert table.places(np.array([1000, 5], np.uint64))[0] == -2


def test_all_byte_letters():
    letters = alignment.byte_letters()
    assert sorted(letters.values()) == list(range(256))
