"""Packing: exact round trips to the tokenizer, gapless sequences, few of them."""

import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest

from metricloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["á ́b é\u0085x\xa0y　z it's I'LL 12³ ΑΣ. <|endoftext|>x", "a\x1cb c", "", None, " \n", "İ 日本語 ̈ 각", "x " * 5000, "same", "same"]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers():
    model, plain = packing.Tokens(PATH), tokenizer()
    for text, ids in zip(ODD, model.ids(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def same_ids(texts):
    model, plain = packing.Tokens(PATH), tokenizer()
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        want = [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in model.ids(some)] == want


def test_ids_of_composed_letters_before_marks():
    changed = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    marks = [chr(m) for m in range(0x21, 0x7F) if not chr(m).isalnum()]
    assert len(changed) > 1000
    same_ids([" ".join(f"a{c}{m}b" for m in marks) for c in changed])


def test_ids_of_random_texts():
    random.seed(7)
    scripts = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x590, 0x700), (0x900, 0xE00), (0xF00, 0x1000), (0x1100, 0x1200)]
    scripts += [(0x1E00, 0x2100), (0x2100, 0x2200), (0x3040, 0x3100), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0xF900, 0xFB50), (0x1D15E, 0x1D165), (0x1F600, 0x1F650)]
    texts = []
    for _ in range(20_000):
        some = random.choices(scripts, k=2) + [(0x20, 0x7F)]
        texts.append("".join(chr(random.randrange(*random.choice(some))) for _ in range(random.randint(1, 25))))
    same_ids(texts)


def test_ids_of_special_tokens_in_any_case():
    same_ids(["a <|ENDOFTEXT|> b", "<|endoftext|>", "x<|endoftext|>\u0338", "<|startoftext|>İ", "İ\u0316.", "| <|"])


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_whose_polynomials_agree():
    one, other = thue_morse(11), thue_morse(11).translate(str.maketrans("ab", "ba"))
    same_ids([f"x {one} y", f"x {other} y", one + other])


def test_equal_hashes_decide_nothing(monkeypatch):
    monkeypatch.setattr(packing.Flat, "hashes", lambda self, starts, ends: (ends - starts).astype(np.uint64))
    same_ids(["one two six", "ten is red", "", "as we go"])


def check(frame, texts, plain):
    assert (frame.groupby("sequence_id").length.sum() <= packing.SEQUENCE).all()
    for _, g in frame.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    for i, g in frame.groupby("doc_id"):
        ids = np.array([*plain.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        g = g.sort_values("piece")
        assert g.length.sum() == len(ids) and g.piece.tolist() == list(range(len(g)))
        assert (g.length[:-1] == packing.SEQUENCE).all()
        for start, length, crc in zip(g.start, g.length, g.ids_crc32):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc


def test_pack_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(-1 - i, t, "en", None, 0) for i, t in enumerate(ODD)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumnsRenamed({"lang": "length", "source": "row"})
    got = packing.pack(packing.pieces(docs, PATH, docs.columns)).select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got.doc_id) == set(texts)
    check(got, texts, tokenizer())
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / packing.SEQUENCE + 2


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(none, PATH, ["doc_id"])).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    got = packing.pack(packing.pieces(twice, PATH, ["doc_id"])).toPandas()
    assert sorted(got.length) == [1, 3, 3] and got.sequence_id.nunique() == 1


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    lengths = rng.integers(1, 101, 400) if seed % 2 else rng.choice([30, 35, 36, 50, 51, 100, 5], 300)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    made = packing.plan(counts, capacity)
    where = sorted((first + k, at + k, offset) for first, n, at, offset in made.placed for k in range(n))
    assert [w[0] for w in where] == list(range(len(lengths)))
    held = {}
    for (_, at, offset), length in zip(where, sorted(lengths.tolist())):
        held.setdefault(at, []).append((offset, length))
    for items in held.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(held) == made.sequences
    assert made.sequences <= best_fit_decreasing(lengths.tolist(), capacity) + 2


def test_configurations_meet_demand():
    found = packing.configurations([50, 34, 33], [10, 12, 30], 100)
    used = sum(np.array(c) * n for c, n in found)
    assert (used <= [10, 12, 30]).all()
    assert sum(n for _, n in found) <= 5 + 6 + 10 and used.sum() >= 45
