"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2**16`` cells. A row's cell comes from its text's hash, so equal texts share a place. Each shard
has virtual nodes on the ring; a cell belongs to the next one clockwise. Shards have room for their even share
of rows and no more: rows that overflow a full shard continue to the next virtual node whose shard has room.
A cell is filled in order of (text hash, id), so groups of equal texts part only where a shard is full.

Only counts by cell reach the driver: at most ``2**16``, and a bounded number of parts of cells that hold far
more rows than others (one text with very many copies), split by a hash of the id. The plan that comes back is
as small, and rows find their place by their number within their part: no part holds a large share of the rows.
"""

from __future__ import annotations

import bisect

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS, PART_BITS = 16, 12


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """``(cell, shard)`` of all virtual nodes, clockwise. A shard's nodes don't depend on the number of shards."""
    return sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}", 0) >> (64 - CELL_BITS), s) for s in range(shards) for v in range(virtual_nodes))


def fill(counts: list[tuple[int, int, int]], rooms: list[int], nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(cell, part, first row, end row, shard, slot of the first row)`` for ``(cell, part, rows)`` in ring order.

    Walks clockwise from each cell's virtual node past full shards; the rooms must hold all rows.
    """
    at = [n[0] for n in nodes]
    used = [0] * len(rooms)
    follow = list(range(len(nodes)))  # the next node whose shard may have room, with paths shortened on the way

    def free(i: int) -> int:
        seen = []
        while used[nodes[i][1]] >= rooms[nodes[i][1]]:
            seen.append(i)
            i = follow[i] if follow[i] != i else (i + 1) % len(nodes)
        for j in seen:
            follow[j] = i
        return i

    plan = []
    for cell, part, rows in sorted(counts):
        i, done = bisect.bisect_left(at, cell) % len(nodes), 0
        while done < rows:
            i = free(i)
            shard = nodes[i][1]
            take = min(rows - done, rooms[shard] - used[shard])
            plan.append((cell, part, done, done + take, shard, used[shard]))
            used[shard] += take
            done += take
    return plan


def sharded(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", virtual_nodes: int = 128) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: one row for each row of ``docs``; counts differ by at most one.

    ``size`` is the text's UTF-8 bytes plus 8; ``slot`` numbers a shard's rows from 0 without gaps. A null text
    counts as having no bytes, with the hash of one. Equal rows are interchangeable; a null id is an id. With
    fewer rows than shards, shards from the last down stay empty; an empty table gives no row.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), h.alias("h"),
        F.shiftrightunsigned(h, 64 - CELL_BITS).cast("int").alias("cell"), F.pmod(F.xxhash64(F.col(doc_id), h), F.lit(1 << PART_BITS)).cast("int").alias("fine"),
    )
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    usual = max(64, 4 * total // (1 << CELL_BITS))
    split = {c: min(PART_BITS, (n // usual).bit_length()) for c, n in counts.items() if n > usual}
    parts = [(c, 0, n) for c, n in counts.items() if c not in split]
    bits = F.lit(0)
    if split:  # at most a quarter of the cells, each into parts of about the usual rows
        wide = F.broadcast(spark.createDataFrame(pd.DataFrame(sorted(split.items()), columns=["_cell", "_bits"]), "_cell int, _bits int"))
        rows = rows.join(wide, F.col("cell") == F.col("_cell"), "left")
        bits = F.coalesce(F.col("_bits"), F.lit(0))
    rows = rows.withColumn("part", F.pmod(F.col("fine"), F.pow(F.lit(2), bits).cast("int")))
    if split:
        heavy = rows.where("_bits is not null").groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")).collect()
        parts += [(r["cell"], r["part"], r["n"]) for r in heavy]
    rooms = [total // shards + (s < total % shards) for s in range(shards)]
    plan = pd.DataFrame(fill(parts, rooms, ring(shards, virtual_nodes)), columns=["_c", "_p", "_a", "_b", "shard", "_slot"])
    plan = F.broadcast(spark.createDataFrame(plan, "_c int, _p int, _a long, _b long, shard int, _slot long"))
    number = F.row_number().over(Window.partitionBy("cell", "part").orderBy("h", "doc_id", "size")) - 1
    placed = rows.withColumn("_n", number.cast("long")).join(
        plan, (F.col("cell") == F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("_n") >= F.col("_a")) & (F.col("_n") < F.col("_b"))
    )
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_n") - F.col("_a")).alias("slot"))
