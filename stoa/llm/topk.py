"""Exact top-k inner products by norm buckets.

Vectors are ordered by length and cut into buckets. A query that already has ``k`` scores of at least ``theta``
needs, of a bucket whose longest vector is ``l``, only vectors at a cosine of ``theta / (|q| l)`` or more. That
local threshold decides: above 1 the bucket is skipped; if high, vectors are pruned by the range that the query's
largest coordinates leave for theirs; else by length, as a prefix of the bucket. What is left is multiplied out
in whole numbers. Every row meets every query's blocks, so nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stoa.session import written

SLACK = 1e-9


@contextmanager
def _batches_of(spark: SparkSession, rows: int):
    """Arrow batches of few rows while blocks of vectors go to Python: a row is up to two blocks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` for each component as double; null for a vector null, or with a null or non-finite part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _blocks(vectors: DataFrame, parts: int, size: int) -> DataFrame:
    """Vectors of one length of array, in order of norm, packed: ``bucket, dim, longest, ids, data``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int, rows: list) -> pa.RecordBatch:
            ids = np.array([r[0] for r in rows], "<i8")
            data = np.array([r[1] for r in rows], "<i8").reshape(len(rows), dim)
            longest = float(np.sqrt((data.astype(float) ** 2).sum(1).max()))
            values = ([rows[0][2]], [dim], [longest], [ids.tobytes()], [data.tobytes()])
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["bucket", "dim", "longest", "ids", "data"])

        for batch in batches:
            for vec_id, vector, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = held.setdefault(len(vector), [])
                own.append((vec_id, vector, part))
                if len(own) == size:
                    yield block(len(vector), own)
                    held[len(vector)] = []
        for dim, own in held.items():
            if own:
                yield block(dim, own)

    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    ordered = vectors.withColumn("norm", norm).repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    return ordered.select("vec_id", "v", F.spark_partition_id().alias("part")).mapInArrow(pack, "bucket int, dim int, longest double, ids binary, data binary")


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums fit 53 bits, else in Python integers."""
    if not q.size or not c.size or float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[-1] < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(object) @ c.astype(object).T


def _best(scores: np.ndarray, row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of (row, score, id) entries, the places of each row's ``k`` highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, row))
    first = np.flatnonzero(np.diff(row[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def bucket_top(q_ids: np.ndarray, q: np.ndarray, theta: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, coordinates_from: float = 0.85) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, vec id, score)`` of each query's best ``k`` in one bucket, leaving out scores below its ``theta``.

    ``c`` is in descending order of length; ``theta`` is minus infinity where a query has no ``k`` scores yet.
    """
    q_len, c_len = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1))
    rows, places = [], []
    reach = q_len * c_len[0]
    local = np.where(reach > 0, theta / np.maximum(reach, 1e-300), np.where(theta > 0, np.inf, -np.inf)) - SLACK
    sharp = (local >= coordinates_from) & (local <= 1)
    flat = local < coordinates_from
    if flat.any():  # by length: products with the prefix that the longest need leaves
        at = np.flatnonzero(flat)
        need = np.where(theta[at] > 0, theta[at] / np.maximum(q_len[at], 1e-300) * (1 - SLACK), -np.inf)
        prefix = np.searchsorted(-c_len, -need, "right")
        for chunk in np.array_split(np.arange(len(at)), -(-len(at) // 256)):
            m = int(prefix[chunk].max())
            s = _products(q[at[chunk]], c[:m])
            keep = s >= np.maximum(theta[at[chunk]], -(2.0**62))[:, None]
            if m > k:  # the k-th place among others: the query's own rows, however many, come last
                s[c_ids[None, :m] == q_ids[at[chunk], None]] = -np.inf if s.dtype == object else np.iinfo(np.int64).min
                keep &= s >= np.partition(s, m - k, axis=1)[:, m - k : m - k + 1]
            r, p = np.nonzero(keep)
            rows.append(at[chunk][r])
            places.append(p)
    if sharp.any():  # by coordinates: ranges that the two largest parts of the query leave for those of a vector
        unit = c / np.maximum(c_len, 1e-300)[:, None]
        for i in np.flatnonzero(sharp).tolist():
            t = min(1.0, max(0.0, local[i]))
            own = q[i] / q_len[i]
            fits = np.ones(len(c), bool)
            for f in np.argsort(-np.abs(own))[:2].tolist():
                wide = np.sqrt((1 - t * t) * max(0.0, 1 - own[f] ** 2))
                low = -1.0 if own[f] < -t else own[f] * t - wide
                high = 1.0 if own[f] > t else own[f] * t + wide
                fits &= (unit[:, f] >= low - SLACK) & (unit[:, f] <= high + SLACK)
            p = np.flatnonzero(fits)
            rows.append(np.full(len(p), i))
            places.append(p)
    row = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    place = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
    other = c_ids[place] != q_ids[row]
    row, place = row[other], place[other]
    score = _row_products(q, c, row, place)
    good = score >= theta[row]
    row, place, score = row[good], place[good], score[good]
    best = _best(score, row, c_ids[place], k)
    return row[best], c_ids[place][best], score[best]


def _row_products(q: np.ndarray, c: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The verified product of each (query, vector) left."""
    out = np.zeros(len(row), np.int64)
    for at in range(0, len(row), 1 << 14):
        own = slice(at, at + (1 << 14))
        out[own] = (q[row[own]] * c[place[own]]).sum(1)
    return out


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
                bucket_rows: int = 2048, query_rows: int = 512) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query row's ``k`` largest inner products over ``vectors``, itself left out.

    Both tables have ``vec_id`` and ``vector``; components become ``floor(scale * x)``. Ties go to the smaller
    id; rows of the query's id are its own; fewer than ``k`` others give fewer rows. Vectors that are null, have
    null or non-finite parts, or no id take no part; vectors of another number of components never meet.
    Scores are longs: lengths whose product reaches 2**62, or a length of 2**53 after scaling, are refused with an error.
    Repeated candidate rows count as often as they occur; query rows of one id give one answer, by its least vector.
    A block of queries goes to those blocks of vectors alone that are long enough for the least of its thresholds.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(vec_id).cast("long").alias("vec_id"), whole_numbers(F.col(vector), scale).alias("v")).where("vec_id is not null and v is not null")

    with _batches_of(spark, 2048):
        buckets = written(_blocks(clean(vectors), parts, bucket_rows), "norm-buckets")
        asked = written(_blocks(clean(queries).groupBy("vec_id").agg(F.min("v").alias("v")), parts, query_rows).select("dim", F.col("longest").alias("q_longest"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "query-blocks")

    far = buckets.groupBy("dim").agg(F.max("longest").alias("c")).join(asked.groupBy("dim").agg(F.max("q_longest").alias("q")), "dim", "full")
    beyond = far.agg(F.max(F.greatest(F.coalesce("c", F.lit(0.0)), F.coalesce("q", F.lit(0.0)))).alias("one"), F.max(F.col("c") * F.col("q")).alias("both")).first()
    if (beyond["one"] or 0.0) >= 2.0**53 or (beyond["both"] or 0.0) >= 2.0**62:
        raise OverflowError("vectors too long for 64-bit scores: scale them down")

    def search(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, q_longest, q_ids, q_data, theta, c_ids, c_data in zip(*(batch.column(n).to_pylist() for n in ("dim", "q_longest", "q_ids", "q_data", "theta", "ids", "data")), strict=True):
                    qi, ci = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                    q, c = np.frombuffer(q_data, "<i8").reshape(-1, dim), np.frombuffer(c_data, "<i8").reshape(-1, dim)
                    least = np.frombuffer(theta, "<f8") if theta else np.full(len(qi), -np.inf)
                    row, ids, score = bucket_top(qi, q, least, ci, c, k)
                    if first:
                        least = np.full(len(qi), -np.inf)
                        full = np.bincount(row, minlength=len(qi)) >= k
                        low = np.full(len(qi), np.inf)
                        np.minimum.at(low, row, score.astype(float))
                        least[full] = low[full]
                        values = ([dim], [q_longest], [float(least.min())], [q_ids], [q_data], [least.astype("<f8").tobytes()])
                        kinds = (pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["dim", "q_longest", "least", "q_ids", "q_data", "theta"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

        return run

    with _batches_of(spark, 16):
        # the block with the longest vectors gives every query its first threshold
        seeds = buckets.groupBy("dim").agg(F.max_by(F.struct("ids", "data"), F.struct("longest", "ids")).alias("b")).select("dim", "b.*")
        opened = asked.withColumn("theta", F.lit(None).cast("binary")).join(seeds, "dim")
        opened = written(opened.mapInArrow(search(True), "dim int, q_longest double, least double, q_ids binary, q_data binary, theta binary"), "thresholds")
        # each block of queries goes to each bucket of the norm order whose longest vector could still reach it
        reach = buckets.groupBy("bucket", "dim").agg(F.max("longest").alias("far"))  # a row a bucket
        spread = opened.join(F.broadcast(reach), "dim").where(F.col("far") * F.col("q_longest") * (1 + SLACK) >= F.col("least"))
        near = buckets.join(spread.drop("far"), ["bucket", "dim"]).where(F.col("longest") * F.col("q_longest") * (1 + SLACK) >= F.col("least"))
        pairs = near.select("dim", "q_longest", "q_ids", "q_data", "theta", "ids", "data")
        found = written(pairs.mapInArrow(search(False), "query_id long, vec_id long, score long"), "top-k")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
