"""Near-duplicate documents by word shingles: SimHash groups and MinHash bands for candidates, exact Jaccard similarity for links.

A document is the set of its five-word shingles. It meets others in two ways. SimHash fingerprints of the sets are
linked by covering locality-sensitive hashing (``simhash.fingerprint_links``): no pair of ``RADIUS`` or fewer differing
bits is missed. Pairs at a similarity of 0.8 differ in more bits, though, 4 to 14 on sf0.1, so ``BANDS`` keys of ``ROWS``
least hashes each bring together the rest: a pair at similarity ``s`` misses every band with chance
``(1 - s**ROWS)**BANDS``, 3 in a million at 0.8.
Links are exact, by whole sets, in two steps. Each document is compared with the least one that it meets in any
place, which joins a tight group at one comparison a member, whatever its size. What is left are places that bring
together documents of different groups: those are compared across groups, never within one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.llm.memory import give_back, small_batches
from stoa.llm.rows import row_keys, taken_rows
from stoa.llm.simhash import fingerprint_links, majority
from stoa.operators.components import connected_components
from stoa.session import join_skewed, written

SEED, ROWS, BANDS, RADIUS = 42, 5, 32, 4
_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 2**64, (ROWS * BANDS, 1), np.uint64)
_ODD = _RNG.integers(0, 2**64, (ROWS * BANDS, 1), np.uint64) | np.uint64(1)


def word_hash(parts: list[bytes]) -> int:
    """The signed 64-bit hash of all words in order; no words give zero."""
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(parts), SEED), "big", signed=True) if parts else 0


def shingles(parts: list[bytes], words: int = 5) -> np.ndarray:
    """Distinct hashes of all runs of ``words`` words, ascending; fewer words are one shingle, none give none."""
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = min(words, len(parts))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def split_words(text: str | None) -> list[bytes]:
    """ASCII letters in lower case, words cut at ASCII white space, as ``simhash.fingerprint`` does."""
    return (text or "").encode().lower().split()


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key a band of a set of shingle hashes; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):  # long texts in slices
        x = (hashes[at : at + 2048] ^ _FLIP) * _ODD
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(1))
    raw, width = least.tobytes(), 8 * ROWS
    return [int.from_bytes(xxhash.xxh64_digest(raw[b * width : (b + 1) * width], b), "big", signed=True) for b in range(BANDS)]


def _described(text: Column, words: int) -> Column:
    @F.pandas_udf("h long, n int, fp long, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                parts = split_words(t)
                own = shingles(parts, words)
                rows.append((word_hash(parts), len(own), majority(own.astype(">u8").tobytes()), band_keys(own)))
            yield pd.DataFrame(rows, columns=["h", "n", "fp", "bands"])
        give_back()

    return run(text)


def meetings(firsts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``h, band, key``: the places where documents meet, of ``h, n, fp, bands`` rows. Sets without shingles meet nowhere.

    Place -1 is the group of fingerprints reachable by steps of ``radius`` bits, the others are the MinHash bands.
    """
    some = firsts.where("n > 0")
    linked = connected_components(fingerprint_links(some, radius))
    prints = some.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"))
    named = prints.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("key"), "rows")
    groups = join_skewed(some.select("h", "fp"), named, "fp", "rows").select("h", F.lit(-1).alias("band"), "key")
    return groups.unionByName(some.select("h", F.posexplode("bands").alias("band", "key")))


def similar_links(names: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links from each group's least name to its others; groups are closed over all pairs at ``percent`` or more.

    A set is compared with those not yet reached from it, so a tight group costs about one comparison a member.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, column = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    left, links = np.arange(len(sets)), []
    mark = np.zeros(len(flat), bool)
    while len(left):
        group, todo, left = [int(left[0])], [int(left[0])], left[1:]
        while todo and len(left):
            own = todo.pop()
            near = np.flatnonzero((100 * sizes[left] >= percent * sizes[own]) & (100 * sizes[own] >= percent * sizes[left]))
            if not len(near):
                continue
            some = left[near]
            mine = column[first[own] : first[own] + sizes[own]]
            mark[mine] = True
            starts = np.cumsum(sizes[some]) - sizes[some]
            cells = np.repeat(first[some] - starts, sizes[some]) + np.arange(int(sizes[some].sum()))
            both = np.add.reduceat(mark[column[cells]].astype(np.int64), starts)
            mark[mine] = False
            hit = (100 + percent) * both >= percent * (sizes[own] + sizes[some])
            found = some[hit].tolist()
            group += found
            todo += found
            left = np.delete(left, near[hit])
        root = int(names[group].min())
        links += [(root, int(names[g])) for g in group if int(names[g]) != root]
    return links


def _with_leaders(pairs: DataFrame, texts: DataFrame, words: int, percent: int, block_rows: int) -> DataFrame:
    """Those ``(src, dst)`` of ``pairs`` that are similar. A leader's followers are dealt into blocks, each with the leader.

    ``texts``: ``h, text``. A task holds one leader's set and reads its followers one by one.
    """
    blocks = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    follow = join_skewed(pairs, blocks, "src", "n")
    follow = follow.withColumn("block", F.pmod(F.xxhash64("dst"), F.col("blocks")).cast("int")).select("src", "block", F.col("dst").alias("h"))
    lead = blocks.select("src", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("src").alias("h"))
    rows = follow.unionByName(lead).join(texts, "h").select("src", "block", (F.col("h") != F.col("src")).alias("follows"), "h", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            src, dst = [], []
            for leader, block, follows, h, text in zip(*(batch.column(i) for i in range(5)), strict=True):
                here, found = (leader.as_py(), block.as_py()), shingles(split_words(text.as_py()), words)
                if not follows.as_py():
                    now, own = here, found
                elif here == now:
                    both = len(np.intersect1d(own, found, assume_unique=True))
                    if (100 + percent) * both >= percent * (len(own) + len(found)):
                        src.append(here[0])
                        dst.append(h.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
        give_back()

    return rows.repartition("src", "block").sortWithinPartitions("src", "block", "follows").mapInArrow(compare, "src long, dst long")


def _across(members: DataFrame, words: int, percent: int, block_rows: int, block_shingles: int) -> DataFrame:
    """``(src, dst)`` links of ``component, main, h, n, text`` rows, less those within the component's main group.

    A component above the block sizes is dealt into blocks, those of its main group apart. Every two blocks meet in a
    group of their own, but not two of the main group: no other pair is left out, no task holds more than two blocks,
    and a main group of any size meets each block of the others once.
    """
    totals = members.groupBy("component", "main").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all"))
    need = F.ceil(F.greatest(F.col("rows") / block_rows, F.col("all") / block_shingles)).cast("int")
    sizes = totals.groupBy("component").agg(F.coalesce(F.max(F.when(F.col("main"), need)), F.lit(0)).alias("mains"), F.coalesce(F.max(F.when(~F.col("main"), need)), F.lit(0)).alias("others"), F.sum("rows").alias("rows"))
    dealt = join_skewed(members, sizes, "component", "rows")  # others are blocks 0 .. others - 1, the main group's follow
    place = F.pmod(F.xxhash64("h"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("main"), F.col("others") + place).otherwise(place))
    meets = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    met = F.filter(F.sequence(F.lit(0), meets - 1), lambda x: (x != F.col("own")) | (meets == 1))
    dealt = dealt.where(meets > 0).withColumn("other", F.explode(met))
    dealt = dealt.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets = None, [], []

        def done() -> pa.RecordBatch:
            links = similar_links(np.array(names, np.int64), sets, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["src", "dst"])

        for batch in batches:
            for key, a, b, name, text in zip(*(batch.column(i) for i in range(5)), strict=True):
                here = (key.as_py(), a.as_py(), b.as_py())
                if here != now:
                    if len(names) > 1:
                        yield done()
                    now, names, sets = here, [], []
                names.append(name.as_py())
                sets.append(shingles(split_words(text.as_py()), words))
        if len(names) > 1:
            yield done()
        give_back()

    rows = dealt.select("component", "a", "b", "h", "text").repartition("component", "a", "b").sortWithinPartitions("component", "a", "b")
    return rows.mapInArrow(compare, "src long, dst long")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, block_rows: int = 2048, block_shingles: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id, rows without id last.

    Two texts link if the Jaccard similarity of their sets of shingles is at least ``percent`` hundredths; groups
    are closed over links. Texts equal word for word are one group, null and empty texts another. Rows are told
    apart by themselves, so repeated ids with other texts and rows without id are groups of their own; ties of
    id go to the smaller hash of words, then of the whole row. Columns stay as they are.
    """
    small_batches(docs.sparkSession)
    told = docs.select(*row_keys(docs), F.col(doc_id).alias("id"), _described(F.col(text), words).alias("told"))
    base = written(told.select("k1", "k2", "id", "told.*"), "shingles")
    firsts = written(base.dropDuplicates(["h"]).select("h", "n", "fp", "bands", "k1", "k2"), "distinct")
    keys = meetings(firsts)
    least = keys.groupBy("band", "key").agg(F.min("h").alias("src"), F.max("h").alias("last"), F.count(F.lit(1)).alias("rows")).where("src < last")
    bucket = F.xxhash64("band", "key").alias("bucket")
    shared = written(join_skewed(keys.select("h", bucket), least.select(bucket, "src", "rows"), "bucket", "rows"), "bands")
    wanted = firsts.select("h", "k1", "k2").join(shared.select("h").distinct(), "h", "left_semi")
    met = docs.select(*row_keys(docs), F.col(text).alias("text")).join(wanted, ["k1", "k2"])
    texts = written(met.groupBy("h").agg(F.first("text").alias("text")), "texts")  # equal rows have one text
    first_met = shared.groupBy(F.col("h").alias("dst")).agg(F.min("src").alias("src")).where("src < dst").select("src", "dst")
    near = written(_with_leaders(first_met, texts, words, percent, block_rows), "near")
    classes = connected_components(near)
    named = shared.join(classes.select(F.col("node").alias("h"), "component"), "h", "left").select("bucket", "h", F.coalesce("component", "h").alias("class"))
    mixed = named.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi").select("bucket", "lo", "rows")
    open_ = written(join_skewed(named, mixed, "bucket", "rows").select("h", "class", "lo"), "mixed")
    bodies = connected_components(open_.select(F.col("lo").alias("src"), F.col("class").alias("dst")).distinct())
    left = open_.select("h", "class").distinct()
    counts = left.groupBy("class").agg(F.count(F.lit(1)).alias("rows")).join(bodies.withColumnRenamed("node", "class"), "class")
    main = counts.groupBy("component").agg(F.max_by("class", F.struct("rows", "class")).alias("top"))
    placed = counts.join(main, "component").select("class", "component", (F.col("class") == F.col("top")).alias("main"), "rows")
    members = join_skewed(left, placed, "class", "rows").join(firsts.select("h", "n"), "h").join(texts, "h").select("component", "main", "h", "n", "text")
    links = near.unionByName(written(_across(written(members, "members"), words, percent, block_rows, block_shingles), "across"))
    groups = connected_components(links)
    rows = base.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("h").alias("h"), F.count(F.lit(1)).alias("rows"))
    rooted = rows.join(groups, F.col("h") == F.col("node"), "left").withColumn("root", F.coalesce("component", "h"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h", "k1", "k2")
    plan = rooted.groupBy("root").agg(F.min(F.struct(order.alias("order"), "rows")).alias("m"))
    return taken_rows(docs, plan.select("m.order.k1", "m.order.k2", "m.rows", F.lit(1).alias("copies")))
