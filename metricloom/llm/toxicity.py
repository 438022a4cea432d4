"""Toxicity by subword-bag embeddings.

Each word is a bag of vectors: one for the word, one per character n-gram between its start and end marks, hashed into
buckets. The mean over the words of a passage goes through a linear softmax; vectors and softmax are trained jointly in
numpy. A misspelling that was never seen still shares most n-grams with the word it hides. A document is as toxic as its
most toxic passage of `passage` words (immediate repetitions count once), so a long text is not excused by its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import sample
from .text import Flat, labelled, over_texts, parts, segment_sums, stretches

SIZES = range(3, 6)


@dataclass
class Bags:
    """The trained classifier; `toxic` holds, for each bucket, the margin its vector adds to the toxic class."""

    toxic: np.ndarray
    bias: float
    passage: int = 4
    bits: int = 18

    def margins(self, texts: list) -> np.ndarray:
        """Highest margin of any passage; texts without words get the bias alone."""
        words = Flat(texts).words().trimmed().unrepeated()
        out = np.full(len(texts), self.bias)
        if not len(words.starts):
            return out
        grams, which = words.distinct()
        scores = word_means(grams, lambda b: self.toxic[b], self.bits)[which]
        first, counts, of = passages(words.counts, self.passage)
        means = segment_sums(scores, counts) / counts
        has = words.counts > 0
        starts = np.searchsorted(of, np.flatnonzero(has))
        out[has] = np.maximum.reduceat(means, starts) + self.bias
        return out


def passages(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of every passage; the words of a text are dealt evenly to its passages."""
    n = np.maximum(-(-counts // size), (counts > 0).astype(np.int64))
    of = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    total, parts = counts[of], np.maximum(n[of], 1)
    begin, end = total * k // parts, total * (k + 1) // parts
    return (np.cumsum(counts) - counts)[of] + begin, end - begin, of


def word_means(grams, value, bits: int) -> np.ndarray:
    """Mean of `value` over the subwords of each word."""
    total, number = 0.0, np.zeros(grams.n)
    for bucket, counts in grams.buckets(SIZES, bits, whole=True):
        total = total + segment_sums(value(bucket), counts)
        number += counts
    return total / number


def train(
    texts: list, labels: list, dim: int = 8, bits: int = 18, passage: int = 4, steps: int = 1500, rate: float = 0.1, seed: int = 7
) -> Bags:
    """Fit on texts with labels 0/1. Without examples of both classes the bias alone answers.

    Minibatches of passages, AdaGrad steps on the vectors that a batch touches. In the first epoch the passages of a toxic
    document all count as toxic, afterwards only the highest; those of clean documents always count as clean.
    """
    y = np.asarray(labels, np.int64)
    which, tokens, member, number = vocabulary(texts, bits)
    if not len(which) or len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return Bags(np.zeros(1 << bits, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))), passage, bits)
    begin = np.cumsum(number) - number

    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (1 << bits, dim)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.3, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen = [np.full(1 << bits, 1e-12, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
    first, counts, of = passages(tokens, passage)

    def step(chosen: np.ndarray, weight: np.ndarray) -> None:
        tokens, sizes = which[stretches(first[chosen], counts[chosen])], counts[chosen]
        known, local = np.unique(tokens, return_inverse=True)
        buckets, slot = np.unique(member[stretches(begin[known], number[known])], return_inverse=True)
        old = vectors[buckets]
        docs = means(means(old[slot], number[known])[local], sizes)
        logits = docs @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(chosen)), y[of[chosen]]] -= 1
        g = (p * weight[:, None] / weight.sum()).astype(np.float32)
        to_words = spread((g @ softmax.T), sizes, local, len(known))
        to_vectors = spread(to_words, number[known], slot, len(buckets))
        seen[0][buckets] += (to_vectors**2).mean(1)
        vectors[buckets] = old - rate * to_vectors / np.sqrt(seen[0][buckets])[:, None]
        for value, grad, past in ((softmax, docs.T @ g, seen[1]), (bias, g.sum(0), seen[2])):
            past += grad**2
            value -= rate * grad / np.sqrt(past)

    for epoch in range(max(6, min(60, -(-steps * 256 // len(of))))):
        toxic = y[of] == 1
        if epoch:
            values = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64)
            margin = segment_sums((segment_sums(values[member], number) / number)[which], counts) / counts
            ranked = np.lexsort((-margin, of))
            highest = np.zeros(len(of), bool)
            highest[ranked[np.flatnonzero(np.diff(of, prepend=-1))]] = True
            toxic, take = toxic & highest, np.flatnonzero(~toxic | highest)
        else:
            take = np.arange(len(of))
        share = toxic[take].mean()
        weight = np.where(toxic[take], min(0.2 / max(share, 1e-9), 20.0), 1.0)
        order = rng.permutation(len(take))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            step(take[some], weight[some])
    return Bags(vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]), passage, bits)


def vocabulary(texts: list, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in reading order (numbers of different words) and their count per text; for the different
    words the buckets of their subwords in a row, and how many each has."""
    hashes, members, numbers, which, tokens, seen = [], [], [], [], [], 0
    for some in parts(texts):
        words = Flat(some).words().trimmed().unrepeated()
        grams, local = words.distinct()
        listed = list(grams.buckets(SIZES, bits, whole=True))
        owner = np.concatenate([np.repeat(np.arange(grams.n, dtype=np.int32), c) for _, c in listed])
        members.append(np.concatenate([b for b, _ in listed]).astype(np.int32)[np.argsort(owner, kind="stable")])
        numbers.append(np.bincount(owner, minlength=grams.n))
        hashes.append(grams.hash)
        which.append(local + seen)
        tokens.append(words.counts)
        seen += grams.n
    none = np.zeros(0, np.int64)
    if not seen:
        return none, np.concatenate([none, *tokens]), none, none
    _, index, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    number = np.concatenate(numbers)
    member = np.concatenate(members)[stretches((np.cumsum(number) - number)[index], number[index])]
    return inverse[np.concatenate(which)].astype(np.int32), np.concatenate(tokens), member, number[index]


def means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of consecutive stretches, none of them empty."""
    return np.add.reduceat(values, np.cumsum(counts) - counts, axis=0) / counts[:, None].astype(np.float32)


def spread(grads: np.ndarray, counts: np.ndarray, member: np.ndarray, n: int) -> np.ndarray:
    """Gradient of `means(values[member], counts)` with respect to the n values."""
    each = np.repeat(grads / counts[:, None].astype(np.float32), counts, axis=0)
    order = np.argsort(member, kind="stable")
    return np.add.reduceat(each[order], np.searchsorted(member[order], np.arange(n)), axis=0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 3000, chars: int = 10_000_000, text: str = "text") -> Bags:
    """Train on a bounded sample (`rows`, `chars`) of the labelled documents that are not held out."""
    learn = labels.where(labelled(labels)[1])
    return sample.trained(docs, learn, "doc_id", F.col(f"`{label}`").cast("int"), rows, chars, text, train)


def score(docs: DataFrame, model: Bags, keep: list[str], text: str = "text") -> DataFrame:
    """Score every whole text: `row` (struct of the columns `keep`), `score` 0 to 1, `predicted` 1 from 0.5 on.

    Null and empty texts get the score of no evidence; repeated rows get equal scores; an empty table gives no rows. Other
    columns, whatever their names, travel inside `row`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        p = 1 / (1 + np.exp(-np.clip(shared.value.margins(texts), -40, 40)))
        return [p, (p >= 0.5).astype(np.int32)]

    return over_texts(docs, text, keep, run, "score double, predicted int")
