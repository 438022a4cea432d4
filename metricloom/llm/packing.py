"""Best-fit packing of token sequences by a linear grouping scheme.

Documents are cut into pieces of at most `SEQUENCE` tokens, and pieces differ, for packing, by nothing but their length. The
plan is therefore made from the histogram of lengths (at most SEQUENCE counts, whatever the number of documents): large
lengths are rounded up to the largest of their group, groups being equally numerous; a linear program over the few sizes
finds how many sequences hold which configuration; actual lengths take the place of the rounded ones; what is left goes, from
the longest down, to the fullest sequence it fits in. The plan is a list of runs: pieces with consecutive numbers, in the
order of length, go to sequences with consecutive numbers, at one offset. Each piece finds its run by its number.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.settle import settle
from .rows import numbered
from .text import LETTER, SPACE, Flat, Words, classes, give_back, importable, parts, segment_sums, stretches

SEQUENCE = 2048
# Lengths above a share of the sequence are large, and are rounded in so many groups: the schemes of which the best is kept.
SCHEMES = [(share, groups) for share in (1 / 5, 1 / 4, 1 / 3, 0.4999) for groups in (5, 10, 20, 40)]
# Units whose ids a worker remembers.
KNOWN = 300_000
# Code points from which on letters aren't told from other characters, and those that composition can change or reorder.
NEWER = 0x530
COMPOSED = re.compile("[\u0300-\u200f\u2028-\u202f\u205f-\U0010ffff]")


class Tokens:
    """Token ids of texts (little-endian bytes, 32 bits each), put together from the ids of their units.

    Texts are normalised first, as the tokenizer does it (canonical composition, lower case), so that what is cut is what the
    tokenizer cuts. Its pre-tokens never reach across white space, nor from letters to ASCII digits or marks other than an
    apostrophe; letters count as such below `NEWER`, beyond which Unicode is still given new ones. So the ids of a text are
    those of the units between such places, and units repeat. A worker remembers them by their 64-bit hashes: sorted hashes,
    and for each where its letters and its ids lie. Letters are compared: a hash alone decides nothing. Texts with a special
    token, in whatever case, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.normaliser = self.tokenizer.normalizer
        self.tokenizer.normalizer = Sequence([])  # it is given texts that are normalised
        vocabulary = self.tokenizer.get_vocab()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.named = re.compile("|".join(map(re.escape, self.special)) or "(?!)", re.IGNORECASE)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a pre-token
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.letter, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.letters, self.lettered = np.zeros(1 << 20, np.uint32), 0

    def normalised(self, text: str) -> str:
        """What the tokenizer cuts, but for white space, which it drops."""
        return self.normaliser.normalize_str(text) if COMPOSED.search(text) else text.lower()

    def encode(self, units: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and their number per unit. Units of letters only are one pre-token each, which its
        last token tells; others are told apart by the place where a token begins."""
        counts, found = np.zeros(len(units), np.int64), [np.zeros(0, np.uint32)] * len(units)
        for kind in (True, False):
            which = np.flatnonzero(letters == kind)
            for at in range(0, len(which), 1000):
                some = which[at : at + 1000]
                words = [units[i] for i in some]
                text = " ".join(words)
                if kind:
                    ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                    cuts = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])
                if not kind or len(cuts) != len(some) + 1:
                    made = self.tokenizer.encode(text, add_special_tokens=False)
                    ids, starts = np.array(made.ids, np.uint32), np.array(made.offsets, np.int64).reshape(-1, 2)[:, 0]
                    cuts = np.searchsorted(starts, np.cumsum([0, *[len(w) + 1 for w in words]]))
                counts[some] = np.diff(cuts)
                for i, x, y in zip(some.tolist(), cuts.tolist(), cuts[1:].tolist()):
                    found[i] = ids[x:y]
        return np.concatenate([np.zeros(0, np.uint32), *found]), counts

    def learn(self, hashes: np.ndarray, units: list[str], letters: np.ndarray) -> None:
        ids, counts = self.encode(units, letters)
        self.pool, begin = _put(self.pool, self.used, ids, counts)
        self.used += len(ids)
        codes, sizes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(u) for u in units])
        self.letters, letter = _put(self.letters, self.lettered, codes, sizes)
        self.lettered += len(codes)
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.begin, self.count = np.concatenate([self.begin, begin])[order], np.concatenate([self.count, counts])[order]
        self.letter, self.size = np.concatenate([self.letter, letter])[order], np.concatenate([self.size, sizes])[order]

    def same(self, units: Words, at: np.ndarray) -> bool:
        """Whether all units are, letter by letter, those that are remembered in the given places."""
        sizes = units.ends - units.starts
        if (sizes != self.size[at]).any():
            return False
        return bool((units.flat.codes[stretches(units.starts, sizes)] == self.letters[stretches(self.letter[at], sizes)]).all())

    def encoded(self, text: str | None) -> bytes:
        """Ids of a text, by the tokenizer alone."""
        return np.array(whole(self.path).encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list) -> list[bytes]:
        shown = [self.normalised(t or "") for t in texts]
        odd = [i for i, (t, n) in enumerate(zip(texts, shown)) if "|" in n and self.named.search(n) or t and "|" in t and self.named.search(t)]
        for i in odd:
            shown[i] = ""
        out = self.put_together(shown)
        for i in odd:
            out[i] = self.encoded(texts[i])
        return out

    def put_together(self, texts: list[str]) -> list[bytes]:
        flat = Flat(texts, lower=False)
        kinds = classes()[flat.codes]
        letter, other = ((kinds & LETTER) != 0) & (flat.codes < NEWER), (kinds & SPACE) == 0
        mark = other & ~letter & (flat.codes < 128) & (flat.codes != ord("'"))
        cut = np.zeros(len(other) + 1, bool)
        cut[1:-1] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:]) | (other[:-1] != other[1:])
        cut[0] = cut[-1] = True
        edges = np.flatnonzero(cut)
        inside = other[edges[:-1]]
        units = Words(flat, edges[:-1][inside], edges[1:][inside])
        hashes, index, which = np.unique(units.hash, return_index=True, return_inverse=True)
        if len(self.hashes) > KNOWN:
            self.forget()
        new = np.ones(len(hashes), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] != hashes
        if new.any():
            starts, ends = units.starts[index[new]], units.ends[index[new]]
            before = np.concatenate([[0], np.cumsum(letter)])
            strings = [flat.text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            self.learn(hashes[new], strings, before[ends] - before[starts] == ends - starts)
        at = np.searchsorted(self.hashes, hashes)[which]
        if not self.same(units, at):  # two units with one hash
            return [self._spaced(t) for t in texts]
        counts = self.count[at]
        ids = self.pool[stretches(self.begin[at], counts)].astype("<u4").tobytes()
        cuts = 4 * np.concatenate([[0], np.cumsum(segment_sums(counts, units.counts).astype(np.int64))])
        return [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


    def _spaced(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _put(pool: np.ndarray, used: int, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool, larger if need be, with the values after what is used, and where their stretches begin."""
    while used + len(values) > len(pool):
        pool = np.concatenate([pool, np.zeros_like(pool)])
    pool[used : used + len(values)] = values
    return pool, used + np.cumsum(counts) - counts


@lru_cache(2)
def whole(path: str):
    """The tokenizer as it is; few texts need it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text") -> DataFrame:
    """Pieces of every document: `row` (struct of the columns `keep`), `piece`, `start`, `length`, `ids_crc32`.

    A document is its token ids and a final id 0; a null or empty text is that id alone. Only longer documents are cut, into
    pieces of SEQUENCE tokens and a rest. `tokenizer` is a path on every executor. Repeated rows are packed each on its own;
    an empty table gives no rows; other columns travel inside `row`.
    """
    importable(docs.sparkSession)
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    out = T.StructType([frame.schema["row"], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens(tokenizer)
        for batch in batches:
            made, at = [], 0
            for some in parts(batch.column("text").to_pylist()):
                for i, ids in enumerate(model.ids(some), at):
                    ids += bytes(4)
                    for piece, start in enumerate(range(0, len(ids), 4 * SEQUENCE)):
                        part = ids[start : start + 4 * SEQUENCE]
                        made.append((i, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                at += len(some)
            columns = list(zip(*made)) or [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns[1:], kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(columns[0], pa.int64())), *arrays], names=out.names)
        give_back()

    return frame.mapInArrow(run, out)


class Pool:
    """Items in the order of length, descending, taken from the front: runs of (length, first number, count)."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.runs = deque(runs)

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            length, first, count = self.runs.popleft()
            m = min(n, count)
            out.append((length, first, m))
            if m < count:
                self.runs.appendleft((length, first + m, count - m))
            n -= m
        return out


class Plan:
    """Runs of pieces placed so far, and the room left in sequences: by room, runs of (first sequence, count)."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.placed: list[tuple[int, int, int, int]] = []  # first number, count, first sequence, offset
        self.room: list[deque] = [deque() for _ in range(capacity + 1)]

    def open(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def put(self, number: int, count: int, sequence: int, offset: int) -> None:
        self.placed.append((number, count, sequence, offset))

    def configuration(self, slots: list[list[tuple[int, int, int]]], n: int) -> None:
        """n new sequences of one item of each slot."""
        at, queues = self.open(n), [deque(s) for s in slots]
        while n:
            m = min(q[0][2] for q in queues)
            offset = 0
            for q in queues:
                length, first, count = q.popleft()
                self.put(first, m, at, offset)
                offset += length
                if m < count:
                    q.appendleft((length, first + m, count - m))
            self.room[self.capacity - offset].append((at, m))
            at, n = at + m, n - m

    def best_fit(self, length: int, first: int, count: int) -> None:
        while count:
            room = next((r for r in range(length, self.capacity + 1) if self.room[r]), None)
            if room is None:
                n = -(-count // (self.capacity // length))
                self.room[self.capacity].append((self.open(n), n))
                room = self.capacity
            at, n = self.room[room].popleft()
            m = min(n, count)
            if m < n:
                self.room[room].appendleft((at + m, n - m))
            self.put(first, m, at, self.capacity - room)
            self.room[room - length].append((at, m))
            first, count = first + m, count - m


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """How many sequences hold how many items of each size: a linear program over all configurations, rounded down.

    Revised simplex on one row per size; the basis starts with sequences of one size only.
    """
    k = len(sizes)
    listed: list[list[int]] = []

    def extend(i: int, room: int, now: list[int]) -> None:
        if i == k:
            if any(now):
                listed.append(now)
            return
        for n in range(room // sizes[i] + 1):
            extend(i + 1, room - n * sizes[i], [*now, n])

    order = np.argsort(sizes)[::-1]
    back = np.argsort(order)
    sizes = [sizes[i] for i in order]
    extend(0, capacity, [])
    columns = np.array(listed, float)
    need = np.array(demand, float)[order]
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(200 * k):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(0)
        gain = columns @ price
        best = int(gain.argmax())
        if gain[best] <= 1 + 1e-9:
            break
        move, now = inverse @ columns[best], inverse @ need
        ratios = np.where(move > 1e-12, np.maximum(now, 0) / np.where(move > 1e-12, move, 1), np.inf)
        basis[:, int(ratios.argmin())] = columns[best]
    amounts = np.floor(np.maximum(np.linalg.inv(basis) @ need, 0) + 1e-9).astype(int)
    return [(basis[back, j].astype(int), int(n)) for j, n in enumerate(amounts) if n]


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> Plan:
    """The scheme that needs the fewest sequences."""
    return min((scheme(counts, capacity, int(share * capacity), groups) for share, groups in SCHEMES), key=lambda p: p.sequences)


def scheme(counts: dict[int, int], capacity: int, large: int, groups: int) -> Plan:
    """Where the pieces go, numbered from 0 in the order of length, ascending."""
    made, base, runs = Plan(capacity), 0, []
    for length in sorted(counts):
        runs.append((length, base, counts[length]))
        base += counts[length]
    runs.reverse()
    whole = [r for r in runs if r[0] == capacity]
    big = Pool([r for r in runs if large < r[0] < capacity])
    for _, first, count in whole:
        made.put(first, count, made.open(count), 0)
    total = sum(c for _, _, c in big.runs)
    cuts = [total * i // groups for i in range(groups + 1)]
    pools = [Pool(big.take(b - a)) for a, b in zip(cuts, cuts[1:]) if b > a]
    if pools:
        # Groups that begin with the same length have the same size.
        for some, n in configurations([p.runs[0][0] for p in pools], [sum(c for _, _, c in p.runs) for p in pools], capacity):
            have = [sum(c for _, _, c in p.runs) for p in pools]
            n = min([n, *[h // m for h, m in zip(have, some) if m]])
            if n:
                made.configuration([p.take(n) for p, m in zip(pools, some) for _ in range(m)], n)
    rest = [r for p in pools for r in p.runs] + [r for r in runs if r[0] <= large]
    for length, first, count in sorted(rest, key=lambda r: (-r[0], r[1])):
        made.best_fit(length, first, count)
    return made


def pack(cut: DataFrame) -> DataFrame:
    """The pieces (`row`, `piece`, `start`, `length`, `ids_crc32`) with `sequence_id` and `offset`.

    Pieces are numbered by length and a hash of the rest, across all tasks. The driver sees the counts per length; what is
    broadcast are the runs of the plan, whose number depends on SEQUENCE and not on the table.
    """
    importable(cut.sparkSession)
    cut = settle(cut)  # numbering reads it twice
    made = numbered(cut.withColumn("h", F.xxhash64("row", "piece", "ids_crc32")), ["length", "h"])
    counts = {r[0]: r[1] for r in made.groupBy("length").count().collect()}  # SEQUENCE rows at most
    runs = np.array(sorted(plan(counts).placed), np.int64).reshape(-1, 4)
    shared = cut.sparkSession.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def place(numbers: pd.Series) -> pd.DataFrame:
        runs, n = shared.value, numbers.to_numpy()
        at = np.searchsorted(runs[:, 0], n, "right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 2] + n - runs[at, 0], "offset": runs[at, 3]})

    return made.withColumn("place", place("number")).select("row", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
