"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from the look of its text (pairs of character kinds, repetition,
word lengths), gated attention weighs the encodings, and a logistic layer scores the weighted representation. Only documents
carry labels; the attention learns which passages decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import sample
from .text import DIGIT, LETTER, SPACE, UPPER, Flat, classes, labelled, mixed, over_texts, segment_sums
from .toxicity import passages

# Kinds of characters: white space, line feed, lower, upper, digit, other, then these.
MARKS = ".,;:!?|*#&%$<>/-_'\"()"
KINDS = 6 + len(MARKS)
WORDS = 7
SIZE = KINDS * KINDS + WORDS
LIKELY = 0.3


def kinds_of(codes: np.ndarray) -> np.ndarray:
    table = classes()[codes]
    kind = np.full(len(codes), 5, np.uint8)
    kind[(table & LETTER) != 0] = 2
    kind[(table & UPPER) != 0] = 3
    kind[(table & DIGIT) != 0] = 4
    kind[(table & SPACE) != 0] = 0
    kind[codes == 10] = 1
    known = np.full(128, 255, np.uint8)
    known[[ord(m) for m in MARKS]] = np.arange(6, KINDS)
    mark = known[np.minimum(codes, 127)]
    return np.where((mark < 255) & (codes < 128), mark, kind)


def encoded(texts: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of `size` words, and each one's text. A text without words is one passage of zeros."""
    flat = Flat(texts, lower=False)
    words = flat.words()
    first, counts, of = passages(words.counts, size)
    n, empty = len(of), np.flatnonzero(words.counts == 0)
    if not n:
        return np.zeros((len(texts), SIZE), np.float32), np.arange(len(texts))
    kind = kinds_of(flat.codes).astype(np.int64)
    pair = kind[:-1] * KINDS + kind[1:]
    begin = words.starts[first]
    end = words.ends[first + counts - 1]
    inside = end - begin
    at = np.repeat(begin - (np.cumsum(inside) - inside), inside) + np.arange(inside.sum())
    passage = np.repeat(np.arange(n), inside)
    pairs = np.empty((n, KINDS * KINDS), np.float32)
    edges = np.searchsorted(passage, np.arange(0, n + 256, 256))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):  # counts of 256 passages at a time
        rows = min(256, n - 256 * k)
        if rows > 0:
            ids = (passage[a:b] - 256 * k) * (KINDS * KINDS) + pair[np.minimum(at[a:b], len(pair) - 1)]
            pairs[256 * k : 256 * k + rows] = np.bincount(ids, minlength=rows * KINDS * KINDS).reshape(rows, -1)
    pairs /= np.maximum(inside, 1)[:, None]

    h, length = words.hash, (words.ends - words.starts).astype(np.float64)
    owner = np.repeat(np.arange(n), counts)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    keyed = np.unique(mixed(h + owner.astype(np.uint64)), return_index=True)[1]
    distinct = np.bincount(owner[keyed], minlength=n)
    kinds = classes()[flat.codes[words.starts]]
    total = counts.astype(np.float64)
    features = [
        segment_sums(again, counts) / total,
        distinct / total,
        segment_sums(length, counts) / total / 10,
        segment_sums((length <= 2) * 1.0, counts) / total,
        segment_sums((length > 15) * 1.0, counts) / total,
        segment_sums(((kinds & LETTER) == 0) * 1.0, counts) / total,
        np.minimum(total / size, 1),
    ]
    out = np.zeros((n + len(empty), SIZE), np.float32)
    out[:n, : KINDS * KINDS] = pairs
    out[:n, KINDS * KINDS :] = np.stack(features, 1)
    of = np.concatenate([of, empty])
    order = np.argsort(of, kind="stable")
    return out[order], of[order]


@dataclass
class Bags:
    """Encoder (`value`), gated attention (`look`, `gate`, `weigh`) and output of the trained classifier."""

    centre: np.ndarray
    scale: np.ndarray
    parts: dict
    size: int

    def forward(self, x: np.ndarray, of: np.ndarray) -> tuple:
        p = self.parts
        h = np.tanh(x @ p["value"] + p["value0"])
        a, g = np.tanh(h @ p["look"]), 1 / (1 + np.exp(-(h @ p["gate"])))
        e = (a * g) @ p["weigh"]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        counts = np.diff(np.append(starts, len(of)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        weight = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return h, a, g, weight, z, z @ p["out"] + p["out0"], starts, counts

    def scores(self, texts: list) -> np.ndarray:
        x, of = encoded(texts, self.size)
        if not len(texts):
            return np.zeros(0)
        logit = self.forward(np.clip((x - self.centre) * self.scale, -6, 6), of)[5]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def bags(texts: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """`encoded` of many texts, a hundred at a time: they are held once, whatever their number."""
    found = [encoded(texts[i : i + 100], size) for i in range(0, len(texts), 100)]
    of = np.concatenate([o + 100 * i for i, (_, o) in enumerate(found)])
    x, at = np.empty((len(of), SIZE), np.float32), 0
    for i, (part, _) in enumerate(found):
        found[i] = None
        x[at : at + len(part)] = part
        at += len(part)
    return x, of


def train(
    texts: list, labels: list, size: int = 64, hidden: int = 16, steps: int = 600, batch: int = 256, rate: float = 0.01, seed: int = 3
) -> Bags:
    """Fit on texts with labels 0/1, both classes weighing alike; one class only gives its share as the score of any text."""
    rng = np.random.default_rng(seed)
    parts = {
        "value": rng.normal(0, 0.08, (SIZE, hidden)), "value0": np.zeros(hidden),
        "look": rng.normal(0, 0.4, (hidden, hidden)), "gate": rng.normal(0, 0.4, (hidden, hidden)),
        "weigh": rng.normal(0, 0.4, hidden), "out": rng.normal(0, 0.4, hidden), "out0": np.zeros(1),
    }
    y = np.asarray(labels, np.float64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        parts["out"][:], parts["out0"][:] = 0, np.log((share + 1e-3) / (1 - share + 1e-3))
        return Bags(np.zeros(SIZE), np.ones(SIZE), parts, size)
    x, of = bags(texts, size)
    mean = sum(part.sum(0, dtype=np.float64) for part in np.array_split(x, 1 + len(x) // 4096)) / len(x)
    spread = np.sqrt(sum(((part - mean) ** 2).sum(0) for part in np.array_split(x, 1 + len(x) // 4096)) / len(x))
    model = Bags(mean.astype(np.float32), (1 / (spread + 0.01)).astype(np.float32), parts, size)
    x -= model.centre
    x *= model.scale
    np.clip(x, -6, 6, out=x)
    begin = np.searchsorted(of, np.arange(len(y) + 1))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m = {k: np.zeros_like(v) for k, v in parts.items()}
    s = {k: np.zeros_like(v) for k, v in parts.items()}
    for t in range(1, steps + 1):
        some = np.sort(rng.choice(len(y), min(batch, len(y)), replace=False))
        rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in some])
        bx, bof = x[rows].astype(np.float64), np.repeat(np.arange(len(some)), begin[some + 1] - begin[some])
        h, a, g, w, z, logit, starts, counts = model.forward(bx, bof)
        d = (1 / (1 + np.exp(-logit)) - y[some]) * weight[some] / len(some)
        dz = np.repeat(d[:, None] * parts["out"], counts, axis=0)
        dw = (dz * h).sum(1)
        de = w * (dw - np.repeat(np.add.reduceat(w * dw, starts), counts))
        dag = de[:, None] * parts["weigh"]
        da, dg = dag * g * (1 - a * a), dag * a * g * (1 - g)
        dh = (w[:, None] * dz + da @ parts["look"].T + dg @ parts["gate"].T) * (1 - h * h)
        grads = {
            "value": bx.T @ dh, "value0": dh.sum(0), "look": h.T @ da, "gate": h.T @ dg,
            "weigh": (a * g).T @ de, "out": z.T @ d, "out0": np.array([d.sum()]),
        }
        for k, grad in grads.items():
            grad = grad + 1e-4 * parts[k]
            m[k] += 0.1 * (grad - m[k])
            s[k] += 0.001 * (grad * grad - s[k])
            parts[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 3000, chars: int = 12_000_000, text: str = "text") -> Bags:
    """Train on a bounded sample (`rows`, `chars`) of the labelled documents that are not held out."""
    learn = labels.where(labelled(labels)[1])
    return sample.trained(docs, learn, "doc_id", F.col(f"`{label}`").cast("int"), rows, chars, text, train)


def score(docs: DataFrame, model: Bags, keep: list[str], text: str = "text") -> DataFrame:
    """Score every whole text: `row` (struct of the columns `keep`), `score` 0 to 1, `predicted` 1 from 0.3 on.

    Null and empty texts are one empty passage; repeated rows get equal scores; an empty table gives no rows. Other columns,
    whatever their names, travel inside `row`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        p = shared.value.scores(texts)
        return [p, (p >= LIKELY).astype(np.int32)]

    return over_texts(docs, text, keep, run, "score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Documents of good quality, in all their columns."""
    return score(docs, fit(docs, labels, text=text), docs.columns, text).where("predicted = 1").select("row.*")
