"""Whitening of embeddings with an exact covariance: integers split into digits, multiplied as float64 matrices.

Entries become whole numbers ``x``. With ``S`` their sums over ``n`` vectors, ``y = n * x - S`` is centred and whole, so the
covariance is ``Y'Y / n**3`` without any rounding. ``Y`` may have numbers of 60 bits and more: it is split into signed
digits of ``DIGIT`` bits, small enough that a float64 product of ``BLOCK`` rows of two digit matrices stays below 2**53 and
so is exact. Products of equal weight are added as Python integers in each task, cut into pieces that Spark sums, and put
together to whole numbers again. Only then is anything rounded: the matrix goes to an eigenvalue solver, whose vectors
Jacobi rotations in extended precision make orthogonal with respect to the exact matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 18
BLOCK = 1 << 14  # rows of a product: 2 * 17 bits of signed digits and 14 of rows are under 53
PIECE = 40  # bits of the pieces that Spark sums: 2**23 tasks fit a long


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of ``DIGIT`` bits, lowest first, as float64 matrices; ``y`` is of whole numbers, int64 or Python's."""
    out, half = [], 1 << (DIGIT - 1)
    while True:
        low = ((y + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
        if not y.any():
            return out


def gram(y: np.ndarray) -> np.ndarray:
    """``Y'Y`` exactly, as a matrix of Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), BLOCK):
        parts = digits(y[at : at + BLOCK])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (DIGIT * (i + j))
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``: int64 where all fit 62 bits, else Python integers."""
    s = np.array(sums, object)
    if x.size and n * int(np.abs(x).max()) + max(map(abs, sums)) >= 1 << 62:
        return n * x.astype(object) - s
    return n * x - s.astype(np.int64)


def _entries(batch: pa.RecordBatch, dim: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in a batch of the vectors that take part, and their whole numbers."""
    vectors = batch.column("v")
    lengths = np.asarray(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    at = np.flatnonzero(lengths == dim)
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    good = np.isfinite(flat).all(1)
    whole = np.floor(scale * flat[good])
    if whole.size and np.abs(whole).max() >= 2.0**62:
        raise OverflowError("entries times the scale must be below 2**62")
    return at[good], whole.astype(np.int64) + shift


@dataclass(frozen=True)
class Whitening:
    """What the fit finds: the number of vectors, their sums, and the leading components."""

    dim: int
    n: int
    sums: list[int]
    axes: np.ndarray  # a column each, unit length
    values: np.ndarray  # eigenvalues of the covariance of x
    explained: np.ndarray
    scale: float
    shift: int


def leading(exact: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes, eigenvalues and shares of the trace of ``exact / n**3``; axes of no variance are left out.

    The double solution is refined by Jacobi rotations of the exact matrix in extended precision. An axis' sign is that of its largest entry.
    """
    dim, top = len(exact), max((int(abs(v)) for v in exact.ravel()), default=0)
    if not top:
        return np.zeros((dim, 0)), np.zeros(0), np.zeros(0)
    wide = np.longdouble
    down = max(0, top.bit_length() - 1000)  # within the range of doubles
    high = np.array([[float(int(v) >> down) for v in row] for row in exact])
    m = np.array([[wide(h) + wide(float((int(v) >> down) - int(h))) for v, h in zip(row, own, strict=True)] for row, own in zip(exact, high, strict=True)], wide)
    m /= wide(high.max() if high.max() > 0 else 1.0)
    q = np.linalg.eigh(m.astype(float))[1].astype(wide)
    for _ in range(2):  # orthogonal in extended precision
        q = q @ (1.5 * np.eye(dim, dtype=wide) - 0.5 * (q.T @ q))
    b = q.T @ m @ q
    for _ in range(12):
        off = np.abs(b - np.diag(np.diag(b)))
        scale = np.sqrt(np.maximum(np.abs(np.diag(b)), np.finfo(wide).tiny))
        if (off <= 4 * np.finfo(wide).eps * np.minimum(scale[:, None] * scale[None, :], scale.max() ** 2)).all():
            break
        for i in range(dim - 1):
            for j in range(i + 1, dim):
                if b[i, j] == 0:
                    continue
                t = (b[j, j] - b[i, i]) / (2 * b[i, j])
                t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(t * t + 1))
                c = 1 / np.sqrt(t * t + 1)
                turn = np.array([[c, c * t], [-c * t, c]], wide)
                b[:, [i, j]] = b[:, [i, j]] @ turn
                b[[i, j], :] = turn.T @ b[[i, j], :]
                q[:, [i, j]] = q[:, [i, j]] @ turn
    e = np.diag(b)
    order = np.argsort(-e, kind="stable")[:k]
    order = order[e[order] > dim * 64 * np.finfo(wide).eps * e.max()]
    axes = q[:, order]
    axes = (axes / np.sqrt((axes * axes).sum(0))).astype(float)
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = sum(int(exact[i, i]) for i in range(dim))
    # a value of the exact matrix over n**3, in the reach of doubles
    share = e[order] / np.diag(m).sum()
    total = float(trace / n**3) if trace.bit_length() < 1000 else float((trace // n**3))
    return axes, (share * wide(total)).astype(float), share.astype(float)


def _rows(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))


def fit(vectors: DataFrame, vector: str = "embedding", k: int = 8, scale: float = 1024.0, shift: int = 100_000) -> Whitening:
    """The leading ``k`` components of all vectors that take part, in three passes: their length, their sums, the exact products.

    The driver gets one row a dimension, then one a pair of dimensions and piece; each task holds one such matrix.
    """
    rows = _rows(vectors, vector, vector).select("v")
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sizes = rows.where(whole & (F.size("v") > 0)).groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.agg(F.max(F.struct("n", "dim")).alias("top")).first()["top"]
    if usual is None:
        return Whitening(0, 0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), scale, shift)
    dim = usual["dim"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = _entries(batch, dim, scale, shift)[1]
            n += len(x)
            total += x.astype(object).sum(0) if np.abs(x).max(initial=0) >= 1 << 40 else x.sum(0).astype(object)
        places, pieces, values = [dim], [0], [n]
        for i in range(dim):
            for p, v in _pieces(total[i]):
                places.append(i)
                pieces.append(p)
                values.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(pieces, pa.int32()), pa.array(values, pa.int64())], names=["i", "piece", "v"])

    parts = rows.mapInArrow(summed, "i int, piece int, v long").groupBy("i", "piece").agg(F.sum("v").alias("v")).collect()
    sums, n = [0] * dim, 0
    for r in parts:
        if r["i"] == dim:
            n = r["v"]
        else:
            sums[r["i"]] += r["v"] << (PIECE * r["piece"])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for batch in batches:
            x = _entries(batch, dim, scale, shift)[1]
            if len(x):
                total += gram(centred(x, n, sums))
        found = [(i, j, p, v) for i in range(dim) for j in range(i + 1) for p, v in _pieces(total[i, j])]
        columns = [pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "piece", "v"])

    exact = np.zeros((dim, dim), object)
    for r in rows.mapInArrow(multiplied, "i int, j int, piece int, v long").groupBy("i", "j", "piece").agg(F.sum("v").alias("v")).collect():
        exact[r["i"], r["j"]] += r["v"] << (PIECE * r["piece"])
        if r["i"] != r["j"]:
            exact[r["j"], r["i"]] = exact[r["i"], r["j"]]
    axes, values, explained = leading(exact, n, k)
    return Whitening(dim, n, sums, axes, values, explained, scale, shift)


def _pieces(v: int) -> list[tuple[int, int]]:
    """A whole number as ``(place, piece)`` of ``PIECE`` bits each, all of its sign."""
    sign, v, out = (-1 if v < 0 else 1), abs(int(v)), []
    while v:
        out.append((len(out), sign * (v & ((1 << PIECE) - 1))))
        v >>= PIECE
    return [x for x in out if x[1]]


def _whitened(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """``(deviation, whitened)`` of whole vectors."""
    y = centred(x, model.n, model.sums)
    small = y.dtype != object and model.dim * float(np.abs(y).max(initial=0)) ** 2 < 2**62
    deviation = (y * y if small else y.astype(object) ** 2).sum(1)
    if not small and len(deviation) and max(deviation) >= 1 << 63:
        raise OverflowError("a deviation doesn't fit a long")
    w = (y.astype(np.float64) / model.n) @ (model.axes / np.sqrt(model.values))
    return deviation.astype(np.int64), w


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from the vectors themselves.

    Each task centres on its own mean before it multiplies; means of tasks are brought together by their sums.
    """
    k = model.axes.shape[1]
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _whitened(_entries(batch, model.dim, model.scale, model.shift)[1], model)[1]
            if len(w):
                own = w.mean(0)
                gap, at = own - mean, n + len(w)
                m2 += (w - own).T @ (w - own) + np.outer(gap, gap) * (n * len(w) / at)
                mean, n = mean + gap * (len(w) / at), at
        rows = [(-1, -1, float(n))] + [(i, -1, float(n * mean[i])) for i in range(k)] + [(i, j, float(m2[i, j] + n * mean[i] * mean[j])) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "v"])

    found = {(r["i"], r["j"]): r["v"] for r in _rows(vectors, vector, vector).select("v").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([found[i, -1] for i in range(k)]) / model.n
    cov = np.array([[found[i, j] for j in range(k)] for i in range(k)]) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whitened(vectors: DataFrame, model: Whitening, error: float, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row for each vector and component.

    Vectors that are null or empty, hold a null or non-finite entry, or don't have the number of entries that most have take
    no part. Repeated vectors and ids count as often as they occur; null ids stay. Directions without variance are no
    components, so equal vectors alone give no row, as an empty table does. Whole numbers beyond a long are refused.
    """
    k = model.axes.shape[1]
    spark = vectors.sparkSession
    schema = f"vec_id {vectors.select(vec_id).schema[0].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _entries(batch, model.dim, model.scale, model.shift)
            if not len(x):
                continue
            deviation, w = _whitened(x, model)
            m = len(x)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()),
                pa.array(np.repeat(deviation, k), pa.int64()), pa.array(w.ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _rows(vectors, vec_id, vector).mapInArrow(run, schema)
