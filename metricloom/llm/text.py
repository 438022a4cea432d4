"""Texts as arrays of code points: words, hashes and character n-grams of many documents at once.

Every text operator runs inside `over_texts`: Spark partitions the documents, a task sees Arrow batches, and a batch is
worked off in chunks of about `CHUNK` characters, so that the memory of a task follows the longest text and not the table.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CHUNK = 1 << 18
LONG = 64  # code points from which on a stretch is hashed by digest
SPACE, LETTER, DIGIT, UPPER = 1, 2, 4, 8
BASE = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the session was started.

    On a cluster the package is installed on the executors or sent with --py-files, as any other.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), root]))


def over_texts(docs: DataFrame, text: str, keep: list[str], fn: Callable[[list], list], schema: str) -> DataFrame:
    """Apply `fn` to the texts: columns of `schema`, beside a struct `row` with the columns `keep`.

    `fn` gets a list of texts (None for null) and returns one sequence per column of `schema`. Input columns can have any
    names: they travel inside `row`.
    """
    importable(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    # A text that is kept is sent once.
    inside = keep.index(text) if text in keep and isinstance(docs.schema[text].dataType, T.StringType) else None
    frame = docs.select(whole) if inside is not None else docs.select(whole, F.col(f"`{text}`").cast("string").alias("text"))
    added = T.StructType.fromDDL(schema)
    types = [pa_type(f.dataType) for f in added]
    out = T.StructType([frame.schema["row"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            rows = batch.column("row")
            column = pc.struct_field(rows, [inside]) if inside is not None else batch.column("text")
            for at, n in pieces(column):
                got = fn(column.slice(at, n).to_pylist())
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(got, types)]
                yield pa.RecordBatch.from_arrays([rows.slice(at, n), *arrays], names=["row", *added.names])
        give_back()

    return frame.mapInArrow(run, out)


def give_back() -> None:
    """Return freed memory to the system at a task's end: workers are kept, and stages of one application add up otherwise."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def pieces(column: pa.Array, size: int = CHUNK) -> list[tuple[int, int]]:
    """Runs (start, length) of rows whose texts together have about `size` bytes; a longer text is a run of its own."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths) // size
    cuts = np.flatnonzero(np.diff(run)) + 1
    edges = [0, *cuts.tolist(), len(lengths)]
    return [(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def parts(texts: list, size: int = CHUNK) -> Iterator[list]:
    """Consecutive stretches of a list of texts with about `size` characters."""
    some, total = [], 0
    for t in texts:
        some.append(t)
        total += len(t or "")
        if total >= size:
            yield some
            some, total = [], 0
    if some:
        yield some


@lru_cache(1)
def classes() -> np.ndarray:
    """For every code point whether it is a white space of `[\\x20\\x09-\\x0D]`, a letter, a digit, an upper case letter."""
    chars = np.arange(0x110000, dtype=np.uint32).view("U1")
    table = np.char.isalpha(chars) * LETTER + np.char.isnumeric(chars) * DIGIT + np.char.isupper(chars) * UPPER
    table[[0x20, *range(0x09, 0x0E)]] |= SPACE
    return table.astype(np.uint8)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        made = []
        for b in (BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: all output bits depend on all input bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Flat:
    """The code points of several texts in one array, with a line feed after each text."""

    def __init__(self, texts: list, lower: bool = True):
        texts = ["" if t is None else t.lower() if lower else t for t in texts]
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        self.n = len(texts)

    def runs(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of wanted positions; runs don't cross texts where line feeds are unwanted."""
        edges = np.flatnonzero(np.diff(wanted.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        return edges[::2], edges[1::2]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the given stretches, equal for equal stretches.

        Polynomials modulo 2**64 have known collisions among stretches of some thousand code points, so long ones get a digest.
        """
        up, down = powers(len(self.codes) + 1)
        sums = np.empty(len(self.codes) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.codes + np.uint32(1)).astype(np.uint64) * up[: len(self.codes)], out=sums[1:])
        out = mixed((sums[ends] - sums[starts]) * down[starts])
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            out[i] = int.from_bytes(blake2b(self.codes[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return out

    def words(self, letters: bool = False) -> "Words":
        """Runs of letters, or of anything but white space."""
        kinds = classes()[self.codes]
        wanted = (kinds & LETTER) != 0 if letters else (kinds & SPACE) == 0
        return Words(self, *self.runs(wanted))


class Words:
    """Words of all texts in reading order. `counts` per text; `of` gives each word's text."""

    def __init__(self, flat: Flat, starts: np.ndarray, ends: np.ndarray):
        self.flat, self.starts, self.ends = flat, starts, ends
        first = np.searchsorted(starts, flat.starts)
        self.first = first
        self.counts = np.diff(np.append(first, len(starts)))
        self.of = np.repeat(np.arange(flat.n), self.counts)

    def trimmed(self) -> "Words":
        """Without what stands before the first and after the last letter or digit; words without any fall away."""
        at = np.flatnonzero(classes()[self.flat.codes] & (LETTER | DIGIT))
        first, last = np.searchsorted(at, self.starts), np.searchsorted(at, self.ends) - 1
        some = first <= last
        return Words(self.flat, at[first[some]], at[last[some]] + 1)

    def unrepeated(self) -> "Words":
        """Without words that repeat the word before them."""
        again = np.diff(self.hash, prepend=self.hash[:1] + U(1)) == 0
        again[self.first[self.counts > 0]] = False
        return Words(self.flat, self.starts[~again], self.ends[~again])

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = self.flat.hashes(self.starts, self.ends)
        return self._hash

    def distinct(self) -> tuple["Grams", np.ndarray]:
        """The different words, and for every word which of them it is."""
        _, index, inverse = np.unique(self.hash, return_index=True, return_inverse=True)
        return Grams(self.flat.codes, self.starts[index], self.ends[index], self._hash[index]), inverse

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of `size` words in a row and their number per text; a shorter text that has words is one shingle."""
        h = self.hash
        counts = np.where(self.counts >= size, self.counts - size + 1, np.minimum(self.counts, 1))
        begin = np.repeat(self.first - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
        length = np.repeat(np.minimum(self.counts, size), counts)
        out = length.astype(np.uint64)
        for k in range(size):
            at = np.minimum(begin + k, max(len(h) - 1, 0))
            out = np.where(k < length, mixed(out * BASE + h[at]), out)
        return out, counts


class Grams:
    """Character n-grams of a list of words, each between a start and an end mark."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        self.hash = hashes
        self.n = len(starts)
        self.lengths = ends - starts + 2
        offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.offsets = offsets[:-1]
        source = np.arange(offsets[-1]) - np.repeat(self.offsets - starts + 1, self.lengths)
        self.codes = codes[np.clip(source, 0, len(codes) - 1)].astype(np.uint64) + U(3)
        self.codes[self.offsets] = 1
        self.codes[offsets[1:] - 1] = 2
        self.left = np.repeat(offsets[1:], self.lengths) - np.arange(offsets[-1])  # characters up to the word's end

    def buckets(self, sizes: range, bits: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size the hash buckets of all n-grams, in word order, and their number per word.

        With `whole` the words themselves come first, one bucket each.
        """
        if whole:
            yield (mixed(self.hash + U(77)) >> U(64 - bits)).astype(np.int64), np.ones(self.n, np.int64)
        h = np.zeros(len(self.codes), np.uint64)
        for n in range(1, max(sizes) + 1):
            h = h[: len(self.codes) - n + 1] * BASE + self.codes[n - 1 :]
            if n in sizes:
                valid = self.left[: len(h)] >= n
                yield (mixed(h[valid] + U(n)) >> U(64 - bits)).astype(np.int64), np.maximum(self.lengths - n + 1, 0)


def stretches(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of consecutive stretches."""
    return np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given lengths; empty stretches give 0."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def labelled(docs: DataFrame, id_: str = "doc_id") -> tuple:
    """Conditions (held out, may be learned from): crc32 of the id as text modulo 5 is 0, or not."""
    rest = F.crc32(F.col(f"`{id_}`").cast("string").cast("binary")) % 5
    return F.coalesce(rest == 0, F.lit(False)), F.coalesce(rest != 0, F.lit(False))
