"""Document fingerprints as invertible Bloom lookup sketches.

The paragraphs of a text, cut into passages of a few words, are hashed; a digest is added to three cells of a small table
(counts, sums of digests, sums of check hashes). Sketches subtract cell by cell: what two versions share cancels, and peeling
cells with a single digest recovers the digests in which they differ. If that fails, because the versions differ in more
than the sketch can hold, larger sketches are made of both until it succeeds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .text import CHUNK, Flat, U, importable, mixed, stretches

CELLS = 24
PASSAGE = 4  # words, on average
LONGEST = 16
LOAD = 32 << 20  # characters of a range of ids, about
GROWTH = 4


def digests(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the passages of all texts, their number per text, and a hash of each whole text.

    A passage ends with a line, with a word whose hash is a multiple of `PASSAGE`, or with `LONGEST` words: what is put in or
    taken out changes the passages around it and no others. Passages are told apart by how often they came before, so that
    the digests of a text are a set.
    """
    flat = Flat(texts, lower=False)
    words = flat.words()
    whole = flat.hashes(flat.starts, flat.starts + flat.lengths)
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), whole
    h = words.hash
    line = np.cumsum(flat.codes == 10)[words.starts]
    after = np.concatenate([[True], (h[:-1] % U(PASSAGE) == 0) | (np.diff(line) != 0)])
    first = np.flatnonzero(after)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    begin = np.flatnonzero(place % LONGEST == 0)
    size = np.diff(np.append(begin, n))
    out = size.astype(np.uint64)
    for k in range(int(size.max())):
        some = np.flatnonzero(k < size)
        out[some] = mixed(out[some] * U(0x9E3779B97F4A7C15) + h[begin[some] + k])
    of = words.of[begin]
    order = np.lexsort((out, of))
    same = (np.diff(out[order], prepend=U(0)) == 0) & (np.diff(of[order], prepend=-1) == 0)
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out[order] = mixed(out[order] + run.astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return out, np.bincount(of, minlength=len(texts)), whole


def cells_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest, one in every third of the table."""
    third = U(cells // 3)
    return np.stack([mixed(keys + U(j + 1)) % third + U(j) * third for j in range(3)]).astype(np.int64)


class Sketches:
    """Sketches of `n` sets of digests with the same number of cells."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count, self.keys, self.check = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)

    def add(self, keys: np.ndarray, of: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        """Add digests (sign 1) or take them away (-1); returns the cells that changed."""
        at = (cells_of(keys, self.cells) + of * self.cells).ravel()
        signs = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        weight = signs.astype(np.uint64)  # -1 is 2**64 - 1, which subtracts
        np.add.at(self.count, at, np.tile(signs, 3))
        np.add.at(self.keys, at, np.tile(keys * weight, 3))
        np.add.at(self.check, at, np.tile(mixed(keys ^ U(0xA5A5A5A5)) * weight, 3))
        return at

    def __sub__(self, other: "Sketches") -> "Sketches":
        out = Sketches(self.n, self.cells)
        out.count, out.keys, out.check = self.count - other.count, self.keys - other.keys, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recover what the sketches hold: digests, their set, their sign, and which sets came out whole."""
        found, at = [], np.arange(len(self.count))
        while len(at):
            at = at[np.abs(self.count[at]) == 1]
            sign = self.count[at]
            keys = self.keys[at] * sign.astype(np.uint64)
            pure = self.check[at] * sign.astype(np.uint64) == mixed(keys ^ U(0xA5A5A5A5))
            keys, of, sign = keys[pure], at[pure] // self.cells, sign[pure]
            once = np.unique(mixed(keys + of.astype(np.uint64) * U(0x9E3779B97F4A7C15)), return_index=True)[1]
            keys, of, sign = keys[once], of[once], sign[once]
            if not len(keys):
                break
            found.append((keys, of, sign))
            at = np.unique(self.add(keys, of, -sign))
        left = ((self.count != 0) | (self.keys != 0)).reshape(self.n, self.cells).any(1)
        keys, of, sign = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        return keys, of, sign, ~left

    def texts(self, counts: np.ndarray, whole: np.ndarray) -> list[str]:
        """Each sketch, the number of its digests and the hash of its whole text as a string."""
        rows = np.empty((self.n, 12 + 20 * self.cells), np.uint8)
        rows[:, :4] = counts.astype("<u4")[:, None].view(np.uint8)
        rows[:, 4:12] = whole.astype("<u8")[:, None].view(np.uint8)
        for a, (values, kind) in zip((0, 4, 12), ((self.count, "<i4"), (self.keys, "<u8"), (self.check, "<u8"))):
            width = int(kind[2]) * self.cells
            rows[:, 12 + a * self.cells : 12 + a * self.cells + width] = values.reshape(self.n, -1).astype(kind).view(np.uint8)
        return [base64.b64encode(r.tobytes()).decode() for r in rows]


def parsed(fingerprint: str) -> tuple[Sketches, int]:
    """The sketch in a fingerprint and the number of its digests."""
    raw = base64.b64decode(fingerprint)
    out = Sketches(1, (len(raw) - 12) // 20)
    c = out.cells
    out.count = np.frombuffer(raw, "<i4", c, 12).astype(np.int64)
    out.keys, out.check = (np.frombuffer(raw, "<u8", c, 12 + a * c).astype(np.uint64) for a in (4, 12))
    return out, int(np.frombuffer(raw, "<u4", 1)[0])


class Sets:
    """Digests of several texts, and the sketches made of them."""

    def __init__(self, texts: list):
        self.keys, self.counts, self.whole = digests(texts)
        self.begin = np.cumsum(self.counts) - self.counts

    def sketch(self, which: np.ndarray, cells: int) -> Sketches:
        out = Sketches(len(which), cells)
        counts = self.counts[which]
        out.add(self.keys[stretches(self.begin[which], counts)], np.repeat(np.arange(len(which)), counts), 1)
        return out


def likeness(a: Sets, i: np.ndarray, b: Sets, j: np.ndarray) -> np.ndarray:
    """Share of the digests of texts i and j that both have, by what peeling their difference recovers; 1 for two empty ones."""
    total = a.counts[i] + b.counts[j]
    out = np.ones(len(i))
    todo, cells = np.arange(len(i)), CELLS
    while len(todo):
        _, of, _, whole = (a.sketch(i[todo], cells) - b.sketch(j[todo], cells)).peel()
        differ = np.bincount(of, minlength=len(todo))
        out[todo[whole]] = (1 - differ / np.maximum(total[todo], 1))[whole]
        todo, cells = todo[~whole], cells * GROWTH
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compared(texts: list[str], asked: np.ndarray) -> list:
    """For each asked position, its text against the edited one and against the next text in the list."""
    changed = [edited(texts[i], texts[i + 1]) for i in asked]
    own, other = Sets(texts), Sets(changed)
    k = np.arange(len(asked))
    prints = own.sketch(asked, CELLS).texts(own.counts[asked], own.whole[asked])
    return [
        [len(texts[i]) for i in asked],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        prints,
        other.sketch(k, CELLS).texts(other.counts, other.whole),
        likeness(own, asked, other, k),
        likeness(own, asked, own, asked + 1),
    ]


SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, keep: list[str], id_: str = "doc_id", text: str = "text") -> DataFrame:
    """`row` (struct of the columns `keep`) and the columns of SCHEMA, for each text and the next one by ascending id.

    A null text is empty; rows with equal ids (null ids first) follow each other by a hash of their text, and after the last
    row comes the first; equal rows have equal fingerprints. One row is its own next, an empty table gives no rows. Other
    columns travel inside `row`.

    The ids' quantiles cut the table into ranges of about LOAD characters; rows of an id (or of null ids) that fill several
    ranges are dealt by the hash of their text. Texts are moved once, to their range, and each range also gets the first row of
    the range after it; a task reads its sorted rows as a stream and holds about CHUNK characters of it.

    A fingerprint of `CELLS` cells resolves some eighteen differences by itself; likeness is taken from larger sketches of
    the texts where they differ in more.
    """
    spark = docs.sparkSession
    importable(spark)
    shown = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{id_}`").cast("bigint").alias("id"), F.xxhash64(shown).alias("h"), shown.alias("text")
    )
    chars = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // LOAD))
    by = F.coalesce(F.col(f"`{id_}`").cast("bigint").cast("double"), F.lit(-np.inf))
    cuts = np.array(docs.select(by.alias("by")).approxQuantile("by", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else [], np.float64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """Ranges between the cuts. An id that is several cuts has so many rows that it fills ranges of its own: they are
        dealt by hash. (Beyond 2**53 several ids have one double, and stay together.)"""
        known = ids.fillna(-np.inf).to_numpy(np.float64)
        below, upto = np.searchsorted(cuts, known, "left"), np.searchsorted(cuts, known, "right")
        share = (hashes.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        spread = below + 1 + np.minimum((share * (upto - below)).astype(np.int64), upto - below - 1)
        many = (upto - below > 1) & ((np.abs(known) < 2.0**53) | np.isinf(known))
        return pd.Series(np.where(many, spread, upto).astype(np.int32))

    placed = base.withColumn("range", range_of("id", "h"))
    firsts = base.select("id", "h").withColumn("range", range_of("id", "h")).groupBy("range").agg(F.min(F.struct("id", "h")).alias("f"))
    order = W.orderBy("range")
    everywhere = W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.lag("range").over(order), F.last("range").over(everywhere))  # of at most n ranges
    links = firsts.select(F.col("f.id").alias("i"), F.col("f.h").alias("fh"), before.alias("to"))
    found = base.join(F.broadcast(links), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("fh")))
    extra = found.dropDuplicates(["to"]).select("row", "id", "h", "text", F.col("to").alias("range"), F.lit(True).alias("extra"))
    dealt = placed.withColumn("extra", F.lit(False)).unionByName(extra).repartition(n, "range").sortWithinPartitions("range", "extra", "id", "h")
    ready = dealt.select("row", "text", "extra")
    out = T.StructType([base.schema["row"], *T.StructType.fromDDL(SCHEMA).fields])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, ends = [], [], []

        def flush() -> pa.RecordBatch:
            asked = np.flatnonzero(~np.array(ends[:-1], bool))
            every = pa.concat_arrays(rows)
            made = compared(texts, asked)
            return pa.RecordBatch.from_arrays([every.take(pa.array(asked)), *[pa.array(x, k) for x, k in zip(made, kinds)]], names=out.names)

        size = 0
        for batch in batches:
            for i, (t, e) in enumerate(zip(batch.column("text").to_pylist(), batch.column("extra").to_pylist())):
                rows.append(batch.column("row").slice(i, 1))
                texts.append(t)
                ends.append(e)
                size += len(t)
                if size > CHUNK and len(texts) > 1:
                    yield flush()
                    rows, texts, ends, size = rows[-1:], texts[-1:], ends[-1:], len(t)
        if len(texts) > 1:
            yield flush()

    return ready.mapInArrow(run, out)
