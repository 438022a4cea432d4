"""Whitening of embeddings by refined eigenvectors.

Entries are the integers floor(64 c) + 1000000, so the sums and the covariance of all vectors are found exactly: tasks
centre their rows at the rounded means and add up products of narrow slices, which double precision holds without rounding;
integers are merged in rounds. Eigenvectors start in single precision. Iterations after Ogita and Aishima correct all of
them at once by matrix multiplications that are exact beyond double precision, each about squaring the error. Where
eigenvalues lie too close for that to tell their vectors apart, the matrix is projected on the vectors of the cluster, the
shifted small problem is solved, and the iterations go on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .text import importable
from .tree import tree_merged

SCALE, SHIFT = 64, 1_000_000
# Entries from this on have no long; vectors with one take no part.
LARGEST = 2.0**61
BITS = 21  # of a slice: products of slices of BLOCK rows add up to less than 2**53
BLOCK = 1 << (53 - 2 * BITS)
ROUNDS = 20


def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors of `width` finite entries, and these vectors as integers."""
    values = column.flatten().cast(pa.float64())
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(np.maximum(lengths, 0))
    at = np.flatnonzero(lengths == width)
    rows = flat[(ends[at] - width)[:, None] + np.arange(width)] if len(at) else np.zeros((0, width))
    with np.errstate(invalid="ignore", over="ignore"):
        rows = np.floor(rows * SCALE)
        whole = (np.abs(rows) < LARGEST).all(1)
    return at[whole], rows[whole].astype(np.int64) + SHIFT


def exact_gram(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows as Python integers."""
    width = rows.shape[1]
    total = np.zeros((width, width), object)
    for at in range(0, len(rows), BLOCK):
        block = rows[at : at + BLOCK]
        slices = []
        while True:  # the lowest bits first; the last slice has the sign
            if np.abs(block).max(initial=0) < 1 << BITS:
                slices.append(block.astype(np.float64))
                break
            slices.append((block & ((1 << BITS) - 1)).astype(np.float64))
            block = block >> BITS
        for i, a in enumerate(slices):
            for j, b in enumerate(slices[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object)
                total = total + ((product if i == j else product + product.T) << (BITS * (i + j)))
    return total


def _parts(vectors: DataFrame, column: str, width: int, fn) -> DataFrame:
    """`fn` folds the integers of a batch into what the task has so far (None at first)."""
    importable(vectors.sparkSession)
    frame = vectors.select(F.col(f"`{column}`").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            _, rows = integers(batch.column("vector"), width)
            if len(rows):
                found = fn(found, rows)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["part"])

    return frame.mapInArrow(run, "part binary")


@dataclass
class Whitening:
    """What all vectors of `width` entries have in common: `n`, their exact `sums`, eigenvectors and eigenvalues, falling."""

    width: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float = 0.0

    def centres(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rounded means m, sums of the rows less m, and the means of these."""
        middle = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, middle)]
        return np.array(middle, np.int64), np.array(rest, object), np.array([r / self.n for r in rest])

    def known(self, components: int) -> int:
        """Components, of so many, whose eigenvalue is more than rounding."""
        floor = self.width * np.finfo(float).eps * self.values[0] if len(self.values) else 0.0
        return int((self.values[:components] > max(floor, 0.0)).sum())

    def project(self, rows: np.ndarray, components: int) -> np.ndarray:
        """Whitened rows, for the components that have an eigenvalue."""
        middle, _, mean = self.centres()
        k = self.known(components)
        return ((rows - middle).astype(np.float64) - mean) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))

    def deviations(self, rows: np.ndarray) -> list[int]:
        """Sums over the entries of (n x - sum)**2."""
        middle, rest, _ = self.centres()
        near, n = rows - middle, self.n
        wide = int(np.abs(near).max(initial=0)) * n + max(map(abs, rest), default=0)
        if wide * wide * max(self.width, 1) < 1 << 63:
            return ((near * n - rest.astype(np.int64)) ** 2).sum(1).tolist()
        return ((near.astype(object) * n - rest) ** 2).sum(1).tolist()


def fit(vectors: DataFrame, column: str, components: int = 32) -> Whitening:
    """The whitening of all vectors of the most frequent length (of equally frequent ones the longest).

    Null vectors, those with null or non-finite entries or with entries of 2**55 and more, and vectors of another length take no
    part. The driver gets the sums and one matrix of width x width numbers, never rows.
    """
    length = F.size(f"`{column}`")
    sizes = vectors.where(F.col(f"`{column}`").isNotNull() & (length > 0)).groupBy(length.alias("width")).count()
    usual = sizes.orderBy(F.desc("count"), F.desc("width")).first()
    if usual is None:
        return Whitening(0)
    model = Whitening(int(usual["width"]))

    def sums(found, rows):
        n, total = found or (0, np.zeros(rows.shape[1], object))
        if int(np.abs(rows).max()) * len(rows) < 1 << 62:
            return n + len(rows), total + rows.sum(0).astype(object)
        return n + len(rows), total + rows.astype(object).sum(0)

    def both(a, b):
        return tuple(x + y for x, y in zip(a, b))

    nothing = (0, np.zeros(model.width, object))
    model.n, total = tree_merged(_parts(vectors, column, model.width, sums), both, nothing)
    model.sums = [int(s) for s in total]
    if not model.n:
        return model
    middle, rest, _ = model.centres()

    def gram(found, rows):
        made = exact_gram(rows - middle)
        return made if found is None else found + made

    products = tree_merged(_parts(vectors, column, model.width, gram), lambda a, b: a + b, nothing[1])
    high, low = covariance(products, rest, model.n)
    model.trace = float(np.trace(high))
    model.values, model.vectors = eigen(high, low)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def moments(found, rows):
        """Number, mean and centred products of whitened rows."""
        made = shared.value.project(rows, components)
        mean = made.mean(0)
        centred = made - mean
        one = (len(made), mean, centred.T @ centred)
        return one if found is None else pooled(found, one)

    k = model.known(components)
    n, _, spread = tree_merged(_parts(vectors, column, model.width, moments), pooled, (1, np.zeros(k), np.eye(k)))
    model.identity_error = float(np.abs(spread / n - np.eye(k)).max(initial=0.0))
    return model


def pooled(a: tuple, b: tuple) -> tuple:
    """Number, mean and centred products of two sets of rows together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def covariance(products: np.ndarray, rest: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Covariance from exact integers, as the nearest doubles and what these leave."""
    width = len(rest)
    high, low = np.zeros((width, width)), np.zeros((width, width))
    for i in range(width):
        for j in range(i + 1):
            exact = Fraction(int(products[i, j]) * n - int(rest[i]) * int(rest[j]), n * n)
            high[i, j] = high[j, i] = float(exact)
            low[i, j] = low[j, i] = float(exact - Fraction(high[i, j]))
    return high, low


def _slices(high: np.ndarray, low: np.ndarray, axis: int, count: int = 5) -> list[np.ndarray]:
    """Parts of a matrix, of so few bits that products of two parts are exact in double precision."""
    bits = (53 - int(np.ceil(np.log2(max(high.shape[axis], 2))))) // 2
    out = []
    for _ in range(count):
        top = np.abs(high).max(axis, keepdims=True)
        unit = np.where(top > 0, 2.0 ** (np.ceil(np.log2(np.where(top > 0, top, 1.0))) + 53 - bits), 0.0)
        part = (high + unit) - unit
        out.append(part)
        high, low = _sum(high - part, low)
    return out


def _sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b, rounded, and the rounding error."""
    total = a + b
    back = total - a
    return total, (a - (total - back)) + (b - back)


def product(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Matrix product of two pairs (doubles, what they leave), as such a pair: about twice the digits of a double."""
    left, right = _slices(*a, axis=1), _slices(*b, axis=0)
    high = low = np.zeros((a[0].shape[0], b[0].shape[1]))
    for total in range(len(left) - 1, -1, -1):  # the smallest products first
        for i in range(total + 1):
            high, rest = _sum(high, left[i] @ right[total - i])
            low = low + rest
    return _sum(high, low)


def _turned(a: tuple) -> tuple:
    return a[0].T, a[1].T


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Positions of eigenvalues in chains of gaps up to `apart`."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return np.split(order, cuts)


def eigen(high: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix given as doubles and what they leave.

    The largest entry of a vector is positive. Vectors of equal eigenvalues are any orthonormal ones of their space.
    """
    width = len(high)
    scale = float(np.abs(high).max(initial=0.0))
    if not scale:
        return np.zeros(width), np.eye(width)
    power = 2.0 ** -np.ceil(np.log2(scale))  # single precision ends at 1e38
    matrix = (high * power, (np.zeros_like(high) if low is None else low) * power)
    x = (np.linalg.eigh(matrix[0].astype(np.float32))[1].astype(np.float64), np.zeros_like(high))
    values = np.zeros(width)
    for _ in range(ROUNDS):
        gram, image = product(_turned(x), x), product(_turned(x), product(matrix, x))
        error = (np.eye(width) - gram[0]) - gram[1]
        error = (error + error.T) / 2
        image = tuple((part + part.T) / 2 for part in image)
        square, rest = np.diag(image[0]), np.diag(image[1]) + np.diag(image[0]) * np.diag(error)
        values = square + rest
        off = image[0] - np.diag(square)
        largest = np.abs(values).max()
        apart = max(2 * (np.linalg.norm(off) + largest * np.linalg.norm(error)), 2.0**-95 * largest)
        chains = _clusters(values, apart)
        chain = np.empty(width, np.int64)
        for c, some in enumerate(chains):
            chain[some] = c
        same = chain[:, None] == chain[None, :]
        gaps = np.where(same, 1.0, (square[None, :] - square[:, None]) + (rest[None, :] - rest[:, None]))
        change = np.where(same, error / 2, (image[0] + values[None, :] * error) / gaps)
        step = product(x, (change, np.zeros_like(change)))
        x = _sum(x[0], x[1] + step[0])
        solved = False
        for some in chains:
            if len(some) > 1:
                solved |= _solve_chain(matrix, x, some)
        if not solved and np.abs(change).max() < 2.0**-55:
            break
    order = np.argsort(-values, kind="stable")
    vectors = x[0][:, order]
    sign = vectors[np.abs(vectors).argmax(0), np.arange(width)]
    return values[order] / power, vectors * np.where(sign < 0, -1.0, 1.0)


def _solve_chain(matrix: tuple, x: tuple, some: np.ndarray) -> bool:
    """Turn the vectors of close eigenvalues inside their space, to those of the projected, shifted matrix.

    False where they are right already, as far as twice the digits of a double can tell.
    """
    inside = (x[0][:, some], x[1][:, some])
    small = product(_turned(inside), product(matrix, inside))
    k = len(some)
    middle = float(np.diag(small[0]).mean())
    shifted = (small[0] - middle * np.eye(k)) + small[1]
    shifted = (shifted + shifted.T) / 2
    off = np.abs(shifted - np.diag(np.diag(shifted))).max()
    if off <= 2.0**-90 or off <= 2.0**-50 * np.abs(np.diag(shifted)).max():
        return False
    turned = product(inside, (np.linalg.eigh(shifted)[1], np.zeros((k, k))))
    x[0][:, some], x[1][:, some] = turned
    return True


def whiten(vectors: DataFrame, model: Whitening, column: str, keep: list[str], components: int = 32) -> DataFrame:
    """`row` (struct of the columns `keep`), exact `deviation`, and `whitened`: one number per component.

    Only vectors that take part (see `fit`) have a row; repeated rows are whitened each, other columns travel inside `row`.
    A component without an eigenvalue, as of equal or few vectors, is null. An empty table gives no rows. `deviation` is null
    beyond 38 digits.
    """
    importable(vectors.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    frame = vectors.select(whole, F.col(f"`{column}`").alias("vector"))
    out = T.StructType([frame.schema["row"], *T.StructType.fromDDL("deviation decimal(38,0), whitened array<double>").fields])
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    count = min(components, model.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        exact = decimal.Context(prec=50)
        model = shared.value
        for batch in batches if model.n else ():
            at, rows = integers(batch.column("vector"), model.width)
            made = np.full((len(rows), count), np.nan)
            made[:, : model.known(count)] = model.project(rows, count)
            numbers = pa.array(made.ravel(), from_pandas=True)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * count)
            deviation = [exact.create_decimal(d) if d < 10**38 else None for d in model.deviations(rows)]
            arrays = [
                batch.column("row").take(pa.array(at)),
                pa.array(deviation, pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(offsets, numbers),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return frame.mapInArrow(run, out)
