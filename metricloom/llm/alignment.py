"""Tokens of two tokenizers, aligned by the bytes they stand for, with corpus-wide counts of the pairs that meet.

A blank after something that is no white space ends a token of both tokenizers, so a text is cut there into units whose
tokens, groups and pairs don't depend on what stands around them. Workers remember units.

Pairs are counted in two passes. The first lists the different pairs of every document; the distinct pairs get a minimal
perfect hash: buckets of pairs, and in each a cascade of bit arrays in which a pair owns the first place that no other pair
wants. Pairs are then counted in dense vectors by their place, which are added up in rounds; the place holds the pair as well,
so that a look-up is verified. The second pass aligns the documents once more and looks counts up.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.settle import settle
from .text import importable, mixed, over_texts, pieces, stretches

U = np.uint64
BUCKET = 1 << 14  # pairs of a bucket, on average
SLICE = 64  # buckets whose counts one task makes
HELD = 1 << 22  # pairs whose counts are broadcast at once; more take further passes
FAN = 16
KNOWN, KNOWN_CHARS, KNOWN_PAIRS = 450_000, 1 << 24, 1 << 20  # what a worker remembers before it starts anew
BATCH = 1000  # units encoded together
WIDE = 4096  # links of a group from which they are taken from the different tokens of the group
# Fixed value: how the byte-level tokenizer cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEWER = re.compile("[\u0530-\U0010ffff]")  # letters that Unicode added of late: pattern libraries may differ in them
BLANKS = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")


def units(text: str) -> list[str]:
    """The units of a text that isn't empty, each without the blank before it."""
    if BLANKS.search(" " + text):
        found = [u[1:] for u in CUT.split(" " + text)]
    else:
        found = text.split(" ")
    if len(found) > 1 and not found[-1]:  # a blank at the end belongs to the unit before
        found[-2:] = [found[-2] + " "]
    return found


@dataclass
class Aligned:
    """Tokens of texts, one after the other, with the number of their group, and the text of every group."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    text_of: np.ndarray
    texts: int

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        groups = len(self.text_of)
        return np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)

    def totals(self) -> np.ndarray:
        """Per text: tokens of both, groups, links."""
        size_a, size_b = self.sizes()
        per_group = np.stack([size_a, size_b, np.ones_like(size_a), size_a * size_b], 1).astype(np.int64)
        out = np.zeros((self.texts, 4), np.int64)
        np.add.at(out, self.text_of, per_group)
        return out

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, pair of ids and number of links, in blocks; a pair can come more than once."""
        size_a, size_b = self.sizes()
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        narrow = size_a * size_b <= WIDE
        tokens = np.flatnonzero(narrow[self.group_a])
        cuts = np.flatnonzero(np.diff(np.cumsum(size_b[self.group_a[tokens]]) >> 20)) + 1
        for some in np.split(tokens, cuts):
            groups = self.group_a[some]
            a = np.repeat(self.a[some], size_b[groups])
            b = self.b[stretches(first_b[groups], size_b[groups])]
            yield np.repeat(self.text_of[groups], size_b[groups]), a.astype(U) << U(32) | b.astype(U), np.ones(len(a), np.int64)
        for g in np.flatnonzero(~narrow):
            a, times_a = np.unique(self.a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            b, times_b = np.unique(self.b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            step = max(1, (1 << 20) // len(b))
            for at in range(0, len(a), step):
                pairs = (a[at : at + step, None].astype(U) << U(32) | b[None, :].astype(U)).ravel()
                yield np.full(len(pairs), self.text_of[g]), pairs, np.outer(times_a[at : at + step], times_b).ravel()

    def groups(self) -> list[str]:
        """Per text its groups as `a1,a2|b1;a3|b2,b3`."""
        size_a, size_b = self.sizes()
        a, b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        spans = zip((np.cumsum(size_a) - size_a).tolist(), (np.cumsum(size_b) - size_b).tolist(), size_a.tolist(), size_b.tolist())
        out = [f"{a[i]}|{b[j]}" if m == 1 == n else f"{','.join(a[i : i + m])}|{','.join(b[j : j + n])}" for i, j, m, n in spans]
        ends = np.cumsum(np.bincount(self.text_of, minlength=self.texts)).tolist()
        return [";".join(out[x:y]) for x, y in zip([0, *ends], ends)]


class Aligner:
    """Both tokenizers. Special tokens' strings inside texts are plain text."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        shown = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(shown[c] for c in entry) if all(c in shown for c in entry) else entry.encode()
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        self.merging = self._merging(path_a, shown)
        self.length_a = np.fromiter(map(len, self.bytes_a), np.int64)
        self.length_b = np.fromiter(map(len, self.bytes_b), np.int64)

    def _merging(self, path: str, shown: dict[str, int]):
        """The first tokenizer's merges by the rank of what they make, which is several times as fast; None where that can
        differ. It can't if ids are ranks and every entry is what its own text is merged to: two tokens that are merged to an
        entry have been left by merges inside its text, as has the listed pair, so they are that pair."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, cut = given["model"], given["pre_tokenizer"] or {}
        entries = {t: i for t, i in model["vocab"].items() if all(c in shown for c in t)}
        made = [entries.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model["merges"]]
        plain = given["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        merged = [[t.id for t in self.a.model.tokenize(entry)] for entry in entries]
        if not plain or made != sorted(set(made)) or merged != [[i] for i in entries.values()]:
            return None
        ranks = {bytes(shown[c] for c in t): i for t, i in entries.items()}
        return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a blank and the text; None if the tokens' bytes aren't these."""
        if self.merging is not None and not NEWER.search(text):
            a = self.merging.encode_ordinary(" " + text)
        else:
            a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, texts: list[str]) -> tuple[Aligned, np.ndarray]:
        """The texts, each after a blank, and which of them have no tokens as their bytes differ."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ends, bad, at = [], np.zeros(len(texts), bool), 0
        for i in range(0, len(texts), BATCH):
            some = texts[i : i + BATCH]
            lengths = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in some])
            plain = _joinable(some)
            made = self.encode(" ".join(some)) if plain else None
            if made is not None and self._ends(made, lengths):
                found.append(made)
                ends.append(at + lengths)
                at += lengths[-1]
                continue
            for k, t in enumerate(some, i):
                one = self.encode(t)
                if one is None:
                    bad[k] = True
                else:
                    found.append(one)
                    at += int(self.length_a[one[0]].sum())
                ends.append(np.array([at]))
        none = np.zeros(0, np.int64)
        a, b = np.concatenate([none, *[x for x, _ in found]]), np.concatenate([none, *[x for _, x in found]])
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        both = end_a[_among(end_a, end_b)]
        text_ends = np.concatenate([none, *ends])
        # Texts without tokens end where the one before ends; a group belongs to the first text that ends there or later.
        text_of = np.searchsorted(text_ends, both, "left")
        return Aligned(a, b, np.searchsorted(both, end_a), np.searchsorted(both, end_b), text_of, len(texts)), bad

    def _ends(self, made: tuple[np.ndarray, np.ndarray], lengths: np.ndarray) -> bool:
        """Tokens of both end where the texts do."""
        a, b = np.cumsum(self.length_a[made[0]]), np.cumsum(self.length_b[made[1]])
        return bool(_among(lengths, a).all() and _among(lengths, b).all())


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _joinable(some: list[str]) -> bool:
    """Whether units can be encoded together: none begins with a blank or ends in white space."""
    return BLANKS.search(f" {' '.join(some)} ") is None


class Grown:
    """An array that rows are appended to."""

    def __init__(self, *width: int):
        self.rows, self.n = np.zeros((1024, *width), np.int64), 0

    def append(self, rows: np.ndarray) -> None:
        n = self.n + len(rows)
        if n > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.n], np.zeros((n, *self.rows.shape[1:]), np.int64)])
        self.rows[self.n : n] = rows
        self.n = n


class Remembered:
    """Numbers of units, and what was found out about each unit when it was first met."""

    def __init__(self, model: Aligner):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.bad = Grown()
        self.chars = 0

    def full(self) -> bool:
        return len(self.number) > KNOWN or self.chars > KNOWN_CHARS

    def numbers(self, keys: list[str]) -> np.ndarray:
        new = list(set(keys).difference(self.number))
        if new:
            if not _joinable(new):
                single = [k for k in new if not _joinable([k])]
                new = [*set(new).difference(single), *single]
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.chars += sum(map(len, new))
            aligned, bad = self.model.align(new)
            self.bad.append(bad)
            self.learn(aligned)
        return np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))

    def learn(self, aligned: Aligned) -> None:
        raise NotImplementedError

    def documents(self, texts: list) -> tuple[np.ndarray, np.ndarray, list]:
        """Units of the texts in a row, their number per text, and the texts that have to be looked at as a whole."""
        cut = [units(t) if t else [] for t in texts]
        numbers = self.numbers([u for c in cut for u in c])
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        odd = np.flatnonzero(sums(self.bad.rows[numbers], counts)).tolist()
        return numbers, counts, odd

    def whole(self, text: str) -> Aligned | None:
        made, bad = self.model.align([text])
        return None if bad[0] else made


class Pairs(Remembered):
    """Pairs of every unit, numbered; `counts` of documents by that number."""

    def forget(self) -> None:
        super().forget()
        self.pair: dict[int, int] = {}
        self.keys: list[int] = []
        self.begin, self.size, self.pool = Grown(), Grown(), Grown()
        self.counts = np.zeros(0, np.int64)

    def full(self) -> bool:
        return super().full() or len(self.keys) > KNOWN_PAIRS

    def _pair_numbers(self, pairs: np.ndarray) -> list[int]:
        out = [self.pair.setdefault(p, len(self.pair)) for p in pairs.tolist()]
        if len(self.pair) > len(self.keys):
            self.keys.extend(islice(self.pair, len(self.keys), None))
        return out

    def learn(self, aligned: Aligned) -> None:
        text, pair = distinct_links(aligned)
        known, inverse = np.unique(pair, return_inverse=True)
        new = np.array(self._pair_numbers(known), np.int64)[inverse]
        size = np.bincount(text, minlength=aligned.texts)
        self.begin.append(self.pool.n + np.cumsum(size) - size)
        self.size.append(size)
        self.pool.append(new)

    def count(self, texts: list) -> None:
        numbers, counts, odd = self.documents(texts)
        of = np.repeat(np.arange(len(texts)), counts)
        usable = ~np.isin(of, odd)
        met = np.unique(of[usable] << 32 | numbers[usable])
        unit, doc = met & 0xFFFFFFFF, met >> 32
        size = self.size.rows[unit]
        pair = self.pool.rows[stretches(self.begin.rows[unit], size)]
        seen = [np.unique(np.repeat(doc, size) << 32 | pair) & 0xFFFFFFFF]
        for i in odd:
            made = self.whole(texts[i])
            if made is not None:
                seen.append(np.array(self._pair_numbers(distinct_links(made)[1]), np.int64))
        self.counts = np.concatenate([self.counts, np.zeros(len(self.keys) - len(self.counts), np.int64)])
        self.counts += np.bincount(np.concatenate(seen), minlength=len(self.counts))

    def taken(self) -> pa.RecordBatch:
        """Pairs, their hashes and document counts so far, which start again from 0."""
        at = np.flatnonzero(self.counts)
        keys = np.array(self.keys, U)[at]
        made = pa.RecordBatch.from_arrays(
            [pa.array(keys.astype(np.int64)), pa.array((mixed(keys) >> U(1)).astype(np.int64)), pa.array(self.counts[at])],
            names=["pair", "hash", "docs"],
        )
        self.counts[:] = 0
        return made


def distinct_links(aligned: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Texts and their different pairs."""
    none = np.zeros(0, np.int64), np.zeros(0, U)
    blocks = [none, *[_different(text, pair) for text, pair, _ in aligned.links()]]
    return _different(*[np.concatenate(x) for x in zip(*blocks)])


def _different(text: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((pair, text))
    text, pair = text[order], pair[order]
    first = np.ones(len(pair), bool)
    first[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
    return text[first], pair[first]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of integers."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, 0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


_state: dict = {}


def remembered(kind: type, path_a: str, path_b: str, table: Table | None = None) -> Remembered:
    """The worker's memory of that kind, which outlasts a task."""
    key = (kind, path_a, path_b, table and table.name)
    if key not in _state:
        _state.clear()
        model = aligner(path_a, path_b)
        _state[key] = kind(model) if table is None else kind(model, table)
    return _state[key]


def linked(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """`pair` (the first tokenizer's id times 2**32 plus the second's), its `hash` and the `docs` of a task that link it.

    A pair has a row per task that met it, or several where a task had to start its memory anew.
    """
    importable(docs.sparkSession)
    frame = docs.select(F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = remembered(Pairs, path_a, path_b)
        state.counts[:] = 0
        for batch in batches:
            column = batch.column("text")
            for at, n in pieces(column):
                state.count(column.slice(at, n).to_pylist())
                if state.full():
                    yield state.taken()
                    state.forget()
        yield state.taken()

    return frame.mapInArrow(run, "pair long, hash long, docs long")


# Minimal perfect hash


def _wanted(keys: np.ndarray, level: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """The place below `size` that each key wants at a level."""
    return (mixed(keys + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % size).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(keys) >> U(1)) % U(buckets)).astype(np.int64)


def cascade(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Words of 64 bits per level, and all words: a bit is set where exactly one key that is left wants the place."""
    sizes, words = [], [np.zeros(0, U)]
    while len(keys):
        n = -(-2 * len(keys) // 64)
        at = _wanted(keys, len(sizes), U(64 * n))
        times = np.bincount(at, minlength=64 * n)
        words.append(np.packbits(times == 1, bitorder="little").view(U))
        sizes.append(n)
        keys = keys[times[at] > 1]
    return sizes, np.concatenate(words)


class PerfectHash:
    """Places from 0, gapless, of the distinct keys of several buckets (cascades), one bucket after the other."""

    def __init__(self, sizes: list[list[int]], words: list[np.ndarray]):
        levels = max(map(len, sizes), default=0)
        self.sizes, self.base = np.zeros((len(sizes), levels), np.int64), np.zeros((len(sizes), levels), np.int64)
        at = 0
        for i, some in enumerate(sizes):
            self.sizes[i, : len(some)] = some
            self.base[i, : len(some)] = at + np.cumsum(some) - some
            at += sum(some)
        self.words = np.concatenate([np.zeros(0, U), *words])
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones

    def places(self, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places of keys in the buckets of the given positions. Keys that were not hashed get any place or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[rows[left], level]
            left, size = left[size > 0], size[size > 0]
            at = _wanted(keys[left], level, (64 * size).astype(U))
            word, bit = self.base[rows[left], level] + (at >> 6), (at & 63).astype(U)
            hit = (self.words[word] >> bit) & U(1) == 1
            below = np.bitwise_count(self.words[word] & ((U(1) << bit) - U(1))).astype(np.int64)
            out[left[hit]] = (self.rank[word] + below)[hit]
            left = left[~hit]
        return out


FUNCTION = {"bucket": pa.int32(), "n": pa.int64(), "sizes": pa.list_(pa.int32()), "words": pa.binary(), "pairs": pa.binary()}
VECTOR = {"bucket": pa.int32(), "part": pa.int32(), "counts": pa.binary()}


def _schema(columns: dict[str, pa.DataType]) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(pa.schema(columns))


def _table(columns: dict[str, pa.DataType], *values: list) -> pa.Table:
    return pa.table([pa.array(v, k) for v, k in zip(values, columns.values())], names=list(columns))


def _numbers(column: pa.ChunkedArray | pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in column]


def hashed(pairs: DataFrame, buckets: int) -> DataFrame:
    """The hash of distinct pairs: per `bucket` its bit arrays and its `pairs` by their place."""

    def build(group: pa.Table) -> pa.Table:
        keys = group.column("pair").to_numpy().astype(U)
        sizes, words = cascade(keys)
        by_place = np.empty_like(keys)
        by_place[PerfectHash([sizes], [words]).places(keys, np.zeros(len(keys), np.int64))] = keys
        return _table(FUNCTION, [group.column("bucket")[0].as_py()], [len(keys)], [sizes], [words.tobytes()], [by_place.tobytes()])

    bucketed = pairs.select("pair", (F.col("hash") % buckets).cast("int").alias("bucket"))
    return bucketed.groupBy("bucket").applyInArrow(build, _schema(FUNCTION))


def counted(links: DataFrame) -> tuple[DataFrame, int]:
    """From `linked`: the hash of all pairs with their `counts` of documents by place; and its number of buckets.

    A dense vector of counts is made per `SLICE` buckets and share of the tasks, there being as many shares as a pair has
    rows on average, and vectors are added up `FAN` at a time. Nothing passes through the driver.
    """
    importable(links.sparkSession)
    links = settle(links)
    pairs = settle(links.select("pair", "hash").distinct())
    total, rows = pairs.count(), links.count()
    buckets, shares = max(1, -(-total // BUCKET)), max(1, -(-rows // max(total, 1)))
    functions = settle(hashed(pairs, buckets))

    def vectors(given: pa.Table, known: pa.Table) -> pa.Table:
        if not given.num_rows:
            return _table(VECTOR, [], [], [])
        held = Table.of(known, buckets)
        places = held.places(given.column("pair").to_numpy().astype(U))
        if (places < 0).any():
            raise RuntimeError("a pair was not hashed")
        counts = np.zeros(len(held.pairs), np.int64)
        np.add.at(counts, places, given.column("docs").to_numpy())
        cuts = np.cumsum(known.column("n").to_numpy())
        made = [c.tobytes() for c in np.split(counts, cuts[:-1])]
        return _table(VECTOR, known.column("bucket").to_pylist(), [given.column("part")[0].as_py()] * len(made), made)

    def add(group: pa.Table) -> pa.Table:
        total = np.sum(_numbers(group.column("counts"), np.int64), 0)
        return _table(VECTOR, [group.column("bucket")[0].as_py()], [group.column("part")[0].as_py()], [total.tobytes()])

    key = [F.expr(f"bucket div {SLICE}").alias("slice"), F.col("part")]
    bucket = (F.col("hash") % buckets).cast("int").alias("bucket")
    given = links.select("pair", "docs", bucket, (F.spark_partition_id() % shares).alias("part"))
    copies = functions.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dense = given.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(vectors, _schema(VECTOR))
    while shares > 1:
        shares = -(-shares // FAN)
        up = settle(dense).withColumn("part", F.expr(f"int(part div {FAN})"))
        dense = up.groupBy("bucket", "part").applyInArrow(add, _schema(VECTOR))
    return settle(functions.join(dense.select("bucket", "counts"), "bucket")), buckets


@dataclass
class Table:
    """Some buckets of the hash, the pairs at their places and, for look-ups, counts and the highest count of each id."""

    name: str
    buckets: int
    row: np.ndarray
    hash: PerfectHash
    pairs: np.ndarray
    counts: np.ndarray
    highest: np.ndarray

    @classmethod
    def of(cls, known: pa.Table, buckets: int, highest: np.ndarray | None = None) -> Table:
        row = np.full(buckets, -1, np.int64)
        row[known.column("bucket").to_numpy()] = np.arange(known.num_rows)
        made = PerfectHash(known.column("sizes").to_pylist(), _numbers(known.column("words"), U))
        pairs = np.concatenate([np.zeros(0, U), *_numbers(known.column("pairs"), U)])
        counts = [] if highest is None else _numbers(known.column("counts"), np.int64)
        return cls(uuid.uuid4().hex, buckets, row, made, pairs, np.concatenate([np.zeros(0, np.int64), *counts]), highest)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places of pairs; -1 for those of other buckets, -2 for those that should be here and are not."""
        rows = self.row[bucket_of(keys, self.buckets)]
        out, here = np.full(len(keys), -1, np.int64), np.flatnonzero(rows >= 0)
        places = self.hash.places(keys[here], rows[here])
        known = places >= 0
        known[known] = self.pairs[places[known]] == keys[here[known]]
        out[here] = np.where(known, places, -2)
        return out


class Looked(Remembered):
    """Totals of every unit (tokens of both, groups, links, links of the highest count, counts, links whose pair was never
    counted, as units of texts without tokens have) and its groups as text."""

    def __init__(self, model: Aligner, table: Table):
        self.table = table
        super().__init__(model)

    def forget(self) -> None:
        super().forget()
        self.totals = Grown(7)
        self.groups: list[str] = []

    def measured(self, aligned: Aligned) -> np.ndarray:
        out = np.concatenate([aligned.totals(), np.zeros((aligned.texts, 3), np.int64)], 1)
        for text, pair, times in aligned.links():
            places = self.table.places(pair)
            np.add.at(out, (text[places == -2], 6), 1)
            here = places >= 0
            text, times, counts = text[here], times[here], self.table.counts[places[here]]
            best = counts == self.table.highest[(pair[here] >> U(32)).astype(np.int64)]
            np.add.at(out, (text, 4), times * best)
            np.add.at(out, (text, 5), times * counts)
        return out

    def learn(self, aligned: Aligned) -> None:
        self.totals.append(self.measured(aligned))
        self.groups.extend(aligned.groups())

    def look_up(self, texts: list, shown: bool) -> list:
        if self.full():
            self.forget()
        numbers, counts, odd = self.documents(texts)
        totals = sums(self.totals.rows[numbers], counts)
        ends = np.cumsum(counts).tolist()
        groups = [""] * len(texts)
        if shown:
            listed = numbers.tolist()
            groups = [";".join([self.groups[u] for u in listed[x:y]]) for x, y in zip([0, *ends], ends)]
        for i in odd:
            made = self.whole(texts[i])
            totals[i] = 0 if made is None else self.measured(made)[0]
            groups[i] = "" if made is None or not shown else made.groups()[0]
        if totals[:, 6].any():
            raise RuntimeError("a pair of tokens was not there in the first pass: the documents have changed")
        return [*totals.T[:6], groups]


def aligned(docs: DataFrame, path_a: str, path_b: str, keep: list[str], text: str = "text", held: int = HELD) -> DataFrame:
    """`row` (struct of the columns `keep`) and for its text, after a blank, `n_a`, `n_b` (tokens), `n_groups` (of tokens
    between places where tokens of both end), `n_links` (pairs of a token of each in a group), `n_best` (links whose pair is
    in as many documents as any pair of its first id), `count_sum` (documents of the pairs of all links) and `groups`
    (`a1,a2|b1;a3|b2`).

    The first tokenizer is a byte-level one that is given a blank and the text, the second one puts a blank before the text
    itself; paths are those on every executor. Texts that are null, empty or not the bytes of their tokens have no tokens:
    zeros and an empty text. A repeated row counts as a document each. An empty table gives no rows.

    What is broadcast are at most `held` pairs, about, and a number for each of the first tokenizer's ids; each further `held`
    pairs take one more pass over the documents.
    """
    importable(docs.sparkSession)
    table, buckets = counted(linked(docs, path_a, path_b, text))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.concatenate([np.zeros(0, U), *_numbers(batch.column("pairs"), U)])
            counts = np.concatenate([np.zeros(0, np.int64), *_numbers(batch.column("counts"), np.int64)])
            a, at = np.unique(pairs >> U(32), return_inverse=True)
            most = np.zeros(len(a), np.int64)
            np.maximum.at(most, at, counts)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(most)], names=["a", "most"])

    per_id = table.select("pairs", "counts").mapInArrow(highest, "a long, most long").groupBy("a").agg(F.max("most").alias("most"))
    rows = per_id.collect()  # one per id of a vocabulary
    most = np.zeros(max((r["a"] for r in rows), default=0) + 1, np.int64)
    most[[r["a"] for r in rows]] = [r["most"] for r in rows]
    step = max(1, held // BUCKET)
    passes = max(1, -(-buckets // step))
    none = F.lit(0).cast("bigint")
    whole = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    frame = docs.select(whole, F.col(f"`{text}`").cast("string").alias("text"), none.alias("n_best"), none.alias("count_sum"))
    for i in range(passes):
        some = table.where(F.col("bucket").between(i * step, (i + 1) * step - 1)).toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(Table.of(some, buckets, most))
        more = i < passes - 1

        def look_up(texts: list, shared=shared, more=more) -> list:
            return remembered(Looked, path_a, path_b, shared.value).look_up(texts, not more)

        made = over_texts(frame, "text", ["row", "n_best", "count_sum", *(["text"] if more else [])], look_up, COUNTS)
        added = [(F.col(f"row.{c}") + F.col(c)).alias(c) for c in ("n_best", "count_sum")]
        made = made.select("row.row", *(["row.text"] if more else []), "n_a", "n_b", "n_groups", "n_links", *added, "groups")
        frame = settle(made) if more else made
    return frame


COUNTS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
