"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of the character n-grams (1 to 3) of lower-cased words, hashed into buckets; term frequencies are
shares of the text's n-grams, so that a text is scored by looking its words up, whatever its length. The weights are learned
with follow-the-regularised-leader and elastic-net penalties, which leave most of them at zero. A slice of the sample that
takes no part in this sets the temperature of the softmax.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import sample
from .text import Flat, labelled, over_texts, parts, segment_sums

SIZES = range(1, 4)
UNKNOWN = "und"


@dataclass
class Languages:
    """`weights` (buckets x languages) hold the inverse document frequencies already."""

    names: list
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def logits(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Logits before the temperature, and whether a text has a letter."""
        words = Flat(texts).words(letters=True)
        out = np.tile(self.bias, (len(texts), 1))
        has = words.counts > 0
        if has.any():
            grams, which = words.distinct()
            values, number = np.zeros((grams.n, len(self.names))), np.zeros(grams.n)
            for bucket, counts in grams.buckets(SIZES, self.bits, whole=False):
                values += segment_sums(self.weights[bucket], counts)
                number += counts
            sums, total = segment_sums(values[which], words.counts), segment_sums(number[which], words.counts)
            out[has] += SCALE * sums[has] / total[has, None]
        return out, has

    def predict(self, texts: list) -> tuple[list, np.ndarray]:
        logits, has = self.logits(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        return [self.names[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, p.max(1), 0.0)


# Term frequencies are counted per hundred n-grams, which brings features to the order of 1.
SCALE = 100.0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(
    texts: list,
    labels: list,
    bits: int = 18,
    l1: float = 0.02,
    l2: float = 0.05,
    rate: float = 0.3,
    updates: int = 6000,
    calibration: float = 0.15,
    seed: int = 5,
) -> Languages:
    """Fit on texts and their language names; texts without letters teach nothing."""
    names = sorted(set(labels))
    features = [f for some in parts(texts) for f in counted(Flat(some).words(letters=True), bits)]
    use = np.array([i for i, (bucket, _) in enumerate(features) if len(bucket)], np.int64)
    if not len(use):
        return Languages(names, np.zeros((1 << bits, len(names)), np.float32), np.zeros(len(names)), 1.0, bits)
    y = np.searchsorted(names, labels)
    document = np.zeros(1 << bits)
    for bucket, _ in features:
        document[bucket] += 1
    idf = (np.log((1 + len(use)) / (1 + document)) + 1).astype(np.float32)
    rng = np.random.default_rng(seed)
    use = rng.permutation(use)
    kept = use[: int(len(use) * calibration)] if len(use) >= 100 else use[:0]
    learn = use[len(kept) :]

    z, n = np.zeros((1 << bits, len(names)), np.float32), np.zeros((1 << bits, len(names)), np.float32)
    bias, bias_n = np.zeros(len(names)), np.full(len(names), 1e-6)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What the regularised leader is, given its sums: zero wherever |z| stays within the l1 penalty."""
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / rate + l2)).astype(np.float32)

    for _ in range(max(1, min(30, -(-updates // max(1, len(learn)))))):
        for i in rng.permutation(learn):
            bucket, share = features[i]
            x = (SCALE * share * idf[bucket])[:, None]
            w = weights(z[bucket], n[bucket])
            p = softmax((w * x).sum(0) + bias)
            p[y[i]] -= 1
            g = (x * p).astype(np.float32)
            old = n[bucket]
            n[bucket] = old + g * g
            z[bucket] += g - (np.sqrt(n[bucket]) - np.sqrt(old)) / rate * w
            bias_n += p * p
            bias -= rate * p / np.sqrt(bias_n)
    model = Languages(names, weights(z, n) * idf[:, None], bias, 1.0, bits)
    if len(kept):
        logits = np.concatenate([model.logits(some)[0] for some in parts([texts[i] for i in kept])])
        heats = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
        # One doubtful label is added to the slice, spread evenly: without any error the best temperature would be none.
        doubt = 1 / (len(kept) + 1)
        wanted = np.full(logits.shape, doubt / len(names))
        wanted[np.arange(len(kept)), y[kept]] += 1 - doubt
        losses = [-(wanted * np.log(softmax(logits / t) + 1e-300)).sum(1).mean() for t in heats]
        model.temperature = float(heats[int(np.argmin(losses))])
    return model


def counted(words, bits: int):
    """For each text its buckets and their share of the text's n-grams."""
    grams, which = words.distinct()
    listed = list(grams.buckets(SIZES, bits, whole=False))
    owner = np.concatenate([np.repeat(np.arange(grams.n), c) for _, c in listed])
    bucket = np.concatenate([b for b, _ in listed])[np.argsort(owner, kind="stable")]
    number = np.bincount(owner, minlength=grams.n)
    begin = np.cumsum(number) - number
    for first, count in zip(words.first, words.counts):
        own, times = np.unique(which[first : first + count], return_counts=True)
        take = number[own]
        at = np.repeat(begin[own] - (np.cumsum(take) - take), take) + np.arange(take.sum())
        found, inverse = np.unique(bucket[at], return_inverse=True)
        tf = np.bincount(inverse, np.repeat(times, take), len(found))
        yield found.astype(np.int32), (tf / max(tf.sum(), 1)).astype(np.float32)


def fit(docs: DataFrame, lang: str = "lang", rows: int = 3000, chars: int = 8_000_000, text: str = "text") -> Languages:
    """Train on a bounded sample (`rows`, `chars`) of the documents with a language that are not held out."""
    labels = docs.where(labelled(docs)[1]).select("doc_id", F.col(f"`{lang}`").cast("string").alias("lang"))
    return sample.trained(docs, labels, "doc_id", F.col("lang"), rows, chars, text, train)


def predict(docs: DataFrame, model: Languages, keep: list[str], text: str = "text") -> DataFrame:
    """The language of every whole text: `row` (struct of the columns `keep`), `lang_pred`, `score` 0 to 1.

    Null texts, empty texts and texts without a letter are `und` with score 0; equally likely languages go to the first by
    name; repeated rows get equal answers; an empty table gives no rows. Other columns travel inside `row`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return over_texts(docs, text, keep, lambda texts: list(shared.value.predict(texts)), "lang_pred string, score double")


def accepted(docs: DataFrame, text: str = "text", least: float = 0.4) -> DataFrame:
    """Documents whose language is recognised with at least `least`, in all their columns."""
    scored = predict(docs, fit(docs, text=text), docs.columns, text)
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
