"""Near-duplicate documents by SimHash fingerprints, linked through covering locality-sensitive hashing.

A fingerprint's bit is set if it is set in over half of the document's shingle hashes. Two fingerprints link
at ``radius`` or fewer differing bits. The tables follow a covering code: bit ``i`` gets a vector ``m(i)`` of
``radius + 1`` bits, and table ``v`` keeps the bits with odd ``<m(i), v>``. Any ``radius`` differing bits span
at most ``radius`` dimensions, so some non-zero ``v`` is orthogonal to all of them and that table keeps none
of them: every linked pair meets in some bucket. No pair can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.llm.memory import small_batches
from stoa.operators.components import connected_components
from stoa.session import cut, free_name, join_skewed, written

SEED = 42


def majority(hashes: bytes) -> int:
    """The signed 64-bit number whose bits are set in over half of the big-endian 64-bit ``hashes``; of no hashes zero."""
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    raw = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):  # long texts in slices
        ones += np.unpackbits(raw[at : at + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The signed 64-bit fingerprint of one text: ASCII letters in lower case, words cut at ASCII white space.

    A text of fewer than ``words`` words is one shingle; null and empty texts have fingerprint zero.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = xxhash.xxh64_digest(joined, SEED)
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_digest
        hashes = b"".join(
            [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
        )
    return majority(hashes)


def fingerprint_column(text: Column, words: int = 4) -> Column:
    """``fingerprint`` as a vectorised column."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="int64")

    return run(text)


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """The ``2**(radius + 1) - 1`` masks over 64 bits; another ``level`` deals the vectors to other bits."""
    order = np.random.default_rng(1000 + level).permutation(64)
    vector = {int(bit): k % 2 ** (radius + 1) for k, bit in enumerate(order)}
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << bit for bit in range(64) if bin(vector[bit] & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _forest(prints: np.ndarray, radius: int) -> list[list[int]]:
    """Links that join all prints reachable by steps of ``radius`` bits: at most one less than there are prints."""
    left = np.unique(np.asarray(prints, np.int64)).view(np.uint64)
    links: list[list[int]] = []
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            if len(reached) > 64:  # a wave in blocks, so memory stays bounded
                reached, later = reached[:64], reached[64:]
            else:
                later = reached[:0]
            near = np.bitwise_count(reached[:, None] ^ left[None, :]) <= radius
            hit = near.any(0)
            if hit.any():
                who = near[:, hit].argmax(0)
                links += np.stack([reached[who].view(np.int64), left[hit].view(np.int64)], 1).tolist()
                later = np.concatenate([later, left[hit]])
                left = left[~hit]
            reached = later
    return links


def fingerprint_links(prints: DataFrame, radius: int = 4, bucket_cap: int = 32_768) -> DataFrame:
    """``(src, dst)`` links over distinct ``fp`` values whose closure is that of all pairs within ``radius`` bits.

    Buckets of two are compared in place. Larger ones are gathered as arrays and give a spanning forest each,
    never their pairs. Buckets above ``bucket_cap`` are split by another level of covering masks (any linked
    pair within the bucket meets again in one of its parts) until none is left. A level leaves free about half of
    the bits that still were, and no bucket holds more fingerprints than its free bits allow: at radius 4 these are at
    most 32, 23, 16 and 13 bits after one to four levels. Fingerprints that differ in ``radius`` bits alone always
    meet, so the cap is not under ``2**radius``.
    """
    bucket_cap = max(bucket_cap, 2**radius)

    @F.pandas_udf("array<array<long>>")
    def forest(groups: pd.Series) -> pd.Series:
        return pd.Series([_forest(g, radius) for g in groups])

    found = []
    keys: list[str] = []
    members = prints.select("fp").distinct()
    for level in count():
        masks = covering_masks(radius, level)
        tables = F.explode(
            F.array(*[F.struct(F.lit(v).cast("short").alias(f"t{level}"), F.col("fp").bitwiseAND(F.lit(m)).alias(f"k{level}")) for v, m in enumerate(masks)])
        )
        spread = members.withColumn("_part", tables).select("fp", *keys, "_part.*")
        keys = [*keys, f"t{level}", f"k{level}"]
        buckets = cut(spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"))
        found.append(
            buckets.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius)).select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
        )
        middle = buckets.where((F.col("n") > 2) & (F.col("n") <= bucket_cap)).select(*keys)
        grouped = spread.join(middle, keys).groupBy(*keys).agg(F.collect_list("fp").alias("fps"))
        found.append(grouped.select(F.explode(forest("fps")).alias("l")).select(F.col("l")[0].alias("src"), F.col("l")[1].alias("dst")))
        hot = buckets.where(F.col("n") > bucket_cap).select(*keys)
        if hot.isEmpty():
            break
        members = cut(spread.join(hot, keys))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own id included; rows of equal
    fingerprints link at zero bits. Null texts count as empty. A null id gets a row; it is never a component's
    smallest id unless all its ids are null. Repeated rows give repeated results. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    base = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), words).alias("fp")), "simhash")
    return _grouped(base, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(base: DataFrame, radius: int) -> DataFrame:
    """``base`` (``doc_id, fp`` and more) with ``component_id``. A fingerprint or a component may hold any share of the rows."""
    firsts = base.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    linked = connected_components(fingerprint_links(firsts, radius))
    rooted = written(firsts.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", "rows", F.coalesce("component", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    labels = join_skewed(rooted, named, "root", "prints").select("fp", "component_id", "rows")
    return join_skewed(base, labels, "fp", "rows")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id, rows without id last.

    Rows are told apart by themselves: repeated ids with other texts are judged apart, and ties of id go to the
    smaller fingerprint, then to the smaller hash of the whole row. Columns stay as they are.
    """
    small_batches(docs.sparkSession)
    fp, own = free_name(docs, "_print"), free_name(docs, "_row")
    held = written(docs.withColumn(fp, fingerprint_column(F.col(text), words)).withColumn(own, F.monotonically_increasing_id()), "simhash")
    rows = held.select(F.col(own).alias("row"), F.col(fp).alias("fp"), F.col(doc_id).alias("id"), F.xxhash64(*docs.columns).alias("all"))
    prints = rows.select("fp").distinct()
    linked = connected_components(fingerprint_links(prints, radius))
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "all", "row")).alias("first"))
    rooted = best.join(linked, F.col("fp") == F.col("node"), "left").select(F.coalesce("component", "fp").alias("root"), "first")
    keep = rooted.groupBy("root").agg(F.min("first")["row"].alias(own)).select(own)
    return held.join(keep, own, "left_semi").select(*docs.columns)
