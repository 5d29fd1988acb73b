"""Connected components of an edge table by alternating large-star and small-star steps, and by stars within partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoa.session import cut


PART_ROWS = 10_000  # of an edge table, at least, in each of its partitions
LOCAL_ROWS = 1 << 18  # of a partition made stars at once, at most, and one Arrow batch more
HUBS = 1000  # nodes with more than this share of all edge ends, so no more than that many, are joined by broadcast


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("hi", "lo").bitwiseAND(F.lit(0xFFFFFFFFFF))).alias("h"),
    ).first()
    return row["n"], row["h"]


def _few(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` in no more partitions than ``n`` rows need: each map task of a shuffle makes three files, even of no rows."""
    return rows.coalesce(-(-n // PART_ROWS) or 1)


def stars(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node of its component, that one left out."""
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = at[: len(hi)], at[len(hi) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for ends in (a, b, root[a], root[b]):  # the ends and their roots get the lesser root
            np.minimum.at(new, ends, least)
        while (up := new[new]).tobytes() != new.tobytes():
            new = up
        if (new == root).all():
            other = root != np.arange(len(nodes))
            return nodes[other], nodes[root[other]]
        root = new


def _local_stars(edges: DataFrame) -> DataFrame:
    """``edges`` (``hi, lo``) with the same components and no more rows: each partition's, by bounded runs, made stars.

    A partition of up to ``LOCAL_ROWS`` rows comes out as whole stars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            new = stars(rows["hi"].to_numpy(), rows["lo"].to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(x) for x in new], names=["hi", "lo"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= LOCAL_ROWS:
                yield done()
                held, n = [], 0
        if n:
            yield done()

    return edges.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for each node of an edge, the component being its smallest node.

    Self loops and null ends are ignored: a node with no other edge gets no row. Repeated and reversed edges
    count once. Each step reduces by key before its shuffle, keeps at most as many edges as before, and is
    checkpointed to the shared folder; the number of steps grows with the logarithm of a component's size.
    Edges of whole numbers are also made stars within each partition: these need fewer steps, and what one partition
    holds none. Every part of a step lowers the sum of all ends or changes nothing, so the last one leaves stars.
    """
    a, b = F.col(src), F.col(dst)
    edges = cut(
        edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    whole = all(isinstance(f.dataType, T.IntegralType) for f in edges.schema)
    state = _state(edges)
    edges = _few(edges, state[0])
    if whole:
        edges = cut(_local_stars(edges))
    while state[0] and (state[0] > PART_ROWS or not whole):  # else all are in one partition, so stars by now
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        least = least.select("u", F.least("u", "m").alias("m"), (F.col("n") * HUBS > 2 * state[0]).alias("hub"))
        up, hubs = both.where("lo > hi"), F.broadcast(least.where("hub").select("u", "m"))
        met = up.join(hubs, F.col("hi") == F.col("u")).unionByName(
            up.join(hubs, F.col("hi") == F.col("u"), "left_anti").join(least.where("not hub").select("u", "m"), F.col("hi") == F.col("u"))
        )
        large = _few(_few(met.select(F.col("lo").alias("hi"), F.col("m").alias("lo")), state[0]).distinct(), state[0])
        lower = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = (
            large.join(lower, F.col("hi") == F.col("u"))
            .where("lo != m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(lower.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        )
        small = _few(_few(small, state[0]).distinct(), state[0])
        edges = cut(_local_stars(small) if whole else small)
        before, state = state, _state(edges)
        if before == state:
            break
        if whole and state[0] <= PART_ROWS:
            edges = cut(_local_stars(_few(edges, state[0])))
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.unionByName(_few(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct(), state[0]))
