"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of word shingles. Texts with the same words in the same order form a class, and classes are joined:

1. Every class has a MinHash signature; classes that agree in all values of a band are candidates.
2. Candidates of a band meet in blocks. Their signatures are compared some values at a time, and a pair is dropped as soon as
   the posterior probability that its similarity reaches the threshold, given the values seen, is below the tolerance.
3. Classes connected by surviving pairs form a candidate group. Within it all pairs are verified exactly on their shingles,
   again block against block, and counted.

A block holds a bounded number of classes, groups of any size are spread over pairs of blocks, and what leaves a task are
counts and a spanning forest, at most a few rows per class and block, never the pairs themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.settle import salted_join, settle
from .components import components
from .text import Flat, U, Words, importable, mixed, over_texts


# Frames of so many rows (of a hundred bytes at most) are broadcast to texts and signatures; larger ones meet them by key.
FEW = 200_000


@dataclass(frozen=True)
class Settings:
    """`values` MinHash values in bands of `band`; at similarity s a pair is no candidate with probability
    (1 - s**band) ** (values / band), 3e-6 for 0.8. `tolerance` bounds the chance that pruning drops a pair of the threshold
    at a check, of which there is one per `step` values. `block` classes, or `weight` shingles, make a block."""

    words: int = 5
    threshold: float = 0.8
    values: int = 96
    band: int = 4
    step: int = 16
    tolerance: float = 1e-7
    block: int = 256
    weight: int = 400_000


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """After n values, the fewest matches that a pair may have. The prior of a similarity is uniform, so the posterior after m
    matches is Beta(m + 1, n - m + 1), and its mass above t is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(s.step, s.values + 1, s.step):
        mass, m = 0.0, -1
        while mass < s.tolerance:
            m += 1
            mass += comb(n + 1, m) * s.threshold**m * (1 - s.threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def shingled(words: Words, size: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its shingles."""
    hashes, counts = words.shingles(size)
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())]


def digests(words: Words) -> list:
    """For each text the digest of its lower-cased words, letter by letter; None without words."""
    flat = words.flat
    codes, wanted = flat.codes.copy(), np.zeros(len(flat.codes) + 1, bool)
    codes[words.ends] = 10  # whatever white space ends a word
    wanted[words.ends] = True
    inside = np.zeros(len(flat.codes) + 1, np.int32)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    wanted |= np.cumsum(inside) > 0
    before = np.concatenate([[0], np.cumsum(wanted[:-1])])
    cuts = before[np.append(flat.starts, len(flat.codes))].tolist()
    kept = codes[wanted[:-1]]
    return [hashlib.md5(kept[a:b]).digest() if b > a else None for a, b in zip(cuts, cuts[1:])]


def listed(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def signed(sets: list[np.ndarray], s: Settings) -> list:
    """MinHash signatures, four bytes a value; None for empty sets."""
    counts = np.array([len(x) for x in sets])
    out: list = [None] * len(sets)
    has = np.flatnonzero(counts)
    if len(has):
        every = np.concatenate([sets[i] for i in has])
        starts = np.cumsum(counts[has]) - counts[has]
        factors = mixed(np.arange(1, s.values + 1, dtype=np.uint64)) | U(1)
        found = np.empty((len(has), s.values), np.uint32)
        for k, factor in enumerate(factors):
            h = every * factor
            found[:, k] = np.minimum.reduceat((h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(32), starts)
        for i, row in zip(has.tolist(), found):
            out[i] = row.tobytes()
    return out


def forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b in `labels` (each element's label is the smallest element of its set)."""
    parent = labels
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    while (labels[labels] != labels).any():
        labels[:] = labels[labels]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 2000) -> Iterator[pa.Table]:
    """Sorted rows as tables that hold whole groups, of `least` rows or more but at the end."""
    kept: list[pa.RecordBatch] = []

    def cut(rows: pa.Table) -> int:
        """Where the last group begins."""
        n = rows.num_rows
        new = np.zeros(n, bool)
        for k in keys:
            column = rows.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        at = np.flatnonzero(new)
        return int(at[-1]) if len(at) else 0

    waiting = 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            waiting += batch.num_rows
        if waiting >= least:
            rows = pa.Table.from_batches(kept)
            at = cut(rows)
            if at:
                yield rows.slice(0, at)
                kept = rows.slice(at).to_batches()
                waiting = rows.num_rows - at
                least = max(least, 2 * waiting)
    if waiting:
        yield pa.Table.from_batches(kept)


def group_numbers(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, np.int64)
    for k in keys:
        column = rows.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def in_block_pairs(frame: DataFrame, group: str, blocks: DataFrame, member: str) -> DataFrame:
    """Rows of every group dealt to blocks (`blocks`: group, n) by a hash of `member`, one copy for each pair of blocks that
    theirs is in: columns `block`, `x`, `y`."""
    placed = salted_join(frame, blocks, [group], plain_rows=0)
    mine = F.pmod(F.xxhash64(member, F.lit(11)), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    return placed.withColumn("block", mine).withColumn("o", other).withColumns({"x": F.least("block", "o"), "y": F.greatest("block", "o")}).drop("o", "n")


def surviving(rows: pa.Table, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a spanning forest of the pairs that survive pruning. Pairs that are connected already aren't compared."""
    group = group_numbers(rows, ["bucket", "x", "y"])
    block = rows.column("block").to_numpy()
    across = rows.column("x").to_numpy() != rows.column("y").to_numpy()
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(rows.num_rows, s.values)
    labels, checks = np.arange(len(group)), least_matches(s)
    size = np.bincount(group)[group]
    place = np.arange(len(group)) - np.searchsorted(group, group)
    d, live = 1, np.flatnonzero(place + 1 < size)
    while len(live):
        a, b = live, live + d
        some = (labels[a] != labels[b]) & (~across[a] | (block[a] != block[b]))
        a, b = a[some], b[some]
        matches = np.zeros(len(a), np.int64)
        for n, least in checks:
            if not len(a):
                break
            matches = matches + (sig[a, n - s.step : n] == sig[b, n - s.step : n]).sum(1)
            keep = matches >= least
            a, b, matches = a[keep], b[keep], matches[keep]
        if len(a):
            forest(labels, a, b)
        d += 1
        live = live[place[live] + d < size[live]]
    child = np.flatnonzero(labels != np.arange(len(labels)))
    return child, labels[child]


def links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets have a Jaccard similarity of at least `threshold`, exactly: a symmetric matrix."""
    sizes = np.array([len(x) for x in sets])
    every, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column) > 1
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = often[column]
    row, column = row[shared], (np.cumsum(often) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, min(8192, 4_000_000 // max(len(sets), 1)))
    for at in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        slab = np.zeros((len(sets), width), np.float32)
        slab[row[lo:hi], column[lo:hi] - at] = 1
        both += slab @ slab.T
    union = sizes[:, None] + sizes[None, :] - both
    out = both >= threshold * union - 1e-6
    np.fill_diagonal(out, False)
    return out


def join(docs: DataFrame, id_: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """For every document `row` (struct of all columns but the text), `class_id`, `copies`, `links`, `linked_classes`,
    `group_id`, `has_words`.

    `class_id` is the smallest id of the documents with the same words in the same order (lower-cased, split at ASCII white
    space), `copies` their number. `links` counts the other documents with a similarity of at least the threshold, copies
    included, `linked_classes` the other classes. `group_id` is the smallest class of the connected documents. A text with
    fewer words than a shingle is one shingle. Null texts and texts without words link to nothing: `class_id` and `group_id`
    are their own id, `copies` 1. Repeated rows are copies of each other; null ids come first; an empty table gives no rows.
    """
    importable(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]

    def sign(texts: list) -> list:
        words = Flat(texts).words()
        sets = shingled(words, s.words)
        return [digests(words), signed(sets, s), [len(x) for x in sets]]

    shown = F.col(f"`{text}`").cast("string")
    whole = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    made = over_texts(docs.select(whole, shown.alias("text"), F.xxhash64(shown).alias("tid")), "text", ["kept", "tid"], sign, "key binary, sig binary, shingles int")
    # In the search for candidates a class goes by 64 bits of its digest. Should two classes share them, they are candidates
    # for each other, and verified like all others.
    found = settle(made.withColumns({"id": F.col(f"row.kept.`{id_}`"), "tid": F.col("row.tid"), "code": F.xxhash64("key")}))
    worded = found.where("key IS NOT NULL")
    classes = settle(
        worded.groupBy("key").agg(F.min(F.struct("id", "tid")).alias("f"), F.count(F.lit(1)).alias("copies"))
        .select("key", F.xxhash64("key").alias("code"), F.col("f.id").alias("class_id"), F.col("f.tid").alias("tid"), "copies")
    )

    group = components(_candidates(worded.select("code", "sig"), s)).withColumnRenamed("node", "code")
    member = settle(matched(classes, settle(group), ["code"]).select("key", "class_id", "tid", "copies", "component"))
    verified = _verified(docs, member, id_, text, s)
    counted = verified.where("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked_classes"))
    joined = components(verified.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    # The smallest key names a component; its smallest class names the group.
    parts = settle(joined.withColumnRenamed("node", "key").join(classes.select("key", "class_id"), "key"))
    heads = parts.groupBy("component").agg(F.min("class_id").alias("group_id"))
    grouped = salted_join(parts, heads, ["component"], plain_rows=0).select("key", "group_id")
    about = classes.select("key", "class_id", "copies").join(counted, "key", "left").join(grouped, "key", "left")
    rows = found.select(F.col("row.kept").alias("row"), "key", "id")
    told = salted_join(settle(rows), settle(about), ["key"], how="left", plain_rows=0)
    class_id = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id"))
    copies = F.coalesce("copies", F.lit(1).cast("bigint"))
    return told.select(
        "row", class_id.alias("class_id"), copies.alias("copies"), (copies - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("links"),
        F.coalesce("linked_classes", F.lit(0)).cast("bigint").alias("linked_classes"),
        F.when(F.col("group_id").isNull(), class_id).otherwise(F.col("group_id")).alias("group_id"), F.col("key").isNotNull().alias("has_words"),
    )


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join whose right side, a settled frame, is broadcast while it has few rows."""
    return left.join(F.broadcast(right) if right.count() <= FEW else right, keys, how)


def _candidates(signatures: DataFrame, s: Settings) -> DataFrame:
    """Edges (a, b) of class codes that connect whatever pairs survive pruning connect."""
    width = 4 * s.band
    band = lambda b: F.xxhash64(F.substring("sig", b * width + 1, width), F.lit(b))
    bands = signatures.select("code", F.explode(F.array(*[band(b) for b in range(s.values // s.band)])).alias("bucket"))
    # Copies fall into the same buckets: a bucket is of use if it has two different classes.
    often = bands.groupBy("bucket").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).where("lo <> hi")
    members = settle(matched(bands, settle(often.select("bucket")), ["bucket"], "left_semi").distinct())
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    blocks = settle(sizes.select("bucket", F.ceil(F.col("size") / s.block).cast("int").alias("n")))
    codes = settle(members.select("code").distinct())
    wanted = settle(matched(signatures, codes, ["code"], "left_semi").groupBy("code").agg(F.max("sig").alias("sig")))
    dealt = in_block_pairs(members, "bucket", blocks, "code")
    ready = dealt.join(wanted, "code").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["bucket", "x", "y"]):
            child, root = surviving(rows, s)
            codes = rows.column("code").combine_chunks()
            yield pa.RecordBatch.from_arrays([codes.take(pa.array(child)), codes.take(pa.array(root))], names=["a", "b"])

    return ready.select("bucket", "x", "y", "block", "code", "sig").mapInArrow(run, "a long, b long").distinct()


def _verified(docs: DataFrame, member: DataFrame, id_: str, text: str, s: Settings) -> DataFrame:
    """Rows (key, links, linked): documents and classes that a class is linked to within a pair of blocks; and rows (key,
    other): a spanning forest of the links."""
    from_docs = docs.select(F.col(f"`{id_}`").alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("tid"), F.col(f"`{text}`").alias("text"))
    wanted = member.select(F.col("class_id").alias("wid"), F.col("tid").alias("wtid"), "key", "component", "copies")
    if member.count() <= FEW:
        wanted = F.broadcast(wanted)
    texts = from_docs.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("tid") == F.col("wtid")))
    again = over_texts(texts, "text", ["key", "component", "copies"], lambda t: [listed(shingled(Flat(t).words(), s.words))], "shingles array<bigint>")
    sets = settle(again.select("row.*", "shingles").dropDuplicates(["key"]))
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("shingles")).alias("w"))
    blocks = settle(sizes.select("component", F.ceil(F.greatest(F.col("m") / s.block, F.col("w") / s.weight)).cast("int").alias("n")))
    dealt = in_block_pairs(sets, "component", blocks, "key").repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["component", "x", "y"], 500):
            group = group_numbers(rows, ["component", "x", "y"])
            block, copies = rows.column("block").to_numpy(), rows.column("copies").to_numpy()
            across = rows.column("x").to_numpy() != rows.column("y").to_numpy()
            lists = rows.column("shingles").combine_chunks()
            values, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
            ends = ends - ends[0]
            documents, others = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
            labels = np.arange(len(group))
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
                if hi - lo < 2:
                    continue
                linked = links([values[ends[i] : ends[i + 1]] for i in range(lo, hi)], s.threshold)
                if across[lo]:
                    linked &= block[lo:hi, None] != block[None, lo:hi]
                others[lo:hi] = linked.sum(1)
                documents[lo:hi] = linked @ copies[lo:hi]
                a, b = np.nonzero(np.triu(linked))
                forest(labels, a + lo, b + lo)
            keys = rows.column("key").combine_chunks()
            got, child = np.flatnonzero(others), np.flatnonzero(labels != np.arange(len(labels)))
            none = pa.nulls(len(child), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([keys.take(pa.array(got)), keys.take(pa.array(child))]),
                    pa.concat_arrays([pa.nulls(len(got), pa.binary()), keys.take(pa.array(labels[child]))]),
                    pa.concat_arrays([pa.array(documents[got]), none]),
                    pa.concat_arrays([pa.array(others[got]), none]),
                ],
                names=["key", "other", "links", "linked"],
            )

    ready = dealt.select("component", "x", "y", "block", "key", "copies", "shingles")
    return settle(ready.mapInArrow(run, "key binary, other binary, links long, linked long"))


def distinct_documents(docs: DataFrame, id_: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """One document of each group of near duplicates, in all its columns: the one with the smallest id, and the smallest text
    hash where ids are repeated; of rows with equal id and text one. Documents without words all stay."""
    shown = F.col(f"`{text}`").cast("string")
    words = F.coalesce(shown.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    identity = docs.select(F.col(f"`{id_}`").alias("id"), F.xxhash64(shown).alias("tid"), shown.alias("text")).where(F.col("text").isNotNull())
    told = settle(join(identity, "id", "text", s).where("has_words").select("row.id", "row.tid", "group_id"))
    best = told.groupBy("group_id").agg(F.min(F.struct("id", "tid")).alias("f")).select("f.id", "f.tid").withColumn("stays", F.lit(True))
    # What goes is far less than what stays. Rows that are repeated as a whole are merged apart.
    pairs = told.groupBy("id", "tid").agg(F.count(F.lit(1)).alias("n"))
    same = [F.col("p.id").eqNullSafe(F.col("b.id")), F.col("p.tid") == F.col("b.tid")]
    judged = settle(pairs.alias("p").join(best.alias("b"), same, "left").select("p.id", "p.tid", "n", "b.stays"))
    whole = docs.where(words).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_}`").alias("own"), F.xxhash64(shown).alias("h"))

    def at(frame: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = settle(some.select("id", "tid"))
        on = F.col("own").eqNullSafe(F.col("id")) & (F.col("h") == F.col("tid"))
        return frame.join(F.broadcast(some) if some.count() <= FEW else some, on, how)

    once = at(whole, judged.where("stays IS NULL OR n > 1"), "left_anti")
    merged = at(whole, judged.where("stays AND n > 1"), "left_semi").dropDuplicates(["own", "h"])
    return once.unionByName(merged).select("row.*").unionByName(docs.where(~words))
