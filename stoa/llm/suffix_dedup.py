"""Exact removal of repeated passages: two-stage suffix sorting over the segments that may repeat.

Every window of ``n`` bytes is keyed by the least hash of the 32-byte strings within it, so equal windows have
equal keys wherever they stand. Neighbouring windows that owe
their key to the same place form a segment, so no segment holds equal windows. Spark counts keys and segments;
a segment whose key occurs once cannot repeat. Equal segments merge and count as their own neighbours. Where a
key has several different segments, their suffixes are sorted in two stages and the common prefixes of adjacent
suffixes tell which windows repeat. All windows of one key are sorted together, and each window has one key,
so the answer is that of one suffix array over the whole corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoa.llm.memory import give_back, small_batches
from stoa.session import written

GRAM = 32
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_SLICE = 1 << 20


# --- windows of a slice of texts ---------------------------------------------------------------------------


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and those of its inverse."""
    base = 0x9E3779B97F4A7C15 | 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on."""
    words = np.ndarray(len(x) - 7, np.uint64, x.tobytes(), strides=(1,))
    size = len(x) - GRAM + 1
    h = words[:size] * _M[0]
    for k in (1, 2, 3):
        h = (h ^ (h >> np.uint64(29))) * _M[k] + words[8 * k : 8 * k + size] * _M[k - 1]
    h = (h ^ (h >> np.uint64(31))) * _M[0]
    return h ^ (h >> np.uint64(33))


def _window_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` values in a row, by running minima from both ends of blocks."""
    size = len(h) - w + 1
    blocks = np.concatenate([h, np.full(-len(h) % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:size], ahead[w - 1 : w - 1 + size])


def segments(raw: list[bytes], n: int) -> tuple[np.ndarray, ...]:
    """``(text, first window, windows, key, hash)`` of each segment of the texts; windows never leave their text."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    total = int(size.sum())
    if total < n:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    start = np.cumsum(size) - size
    x = np.frombuffer(b"".join(raw), np.uint8)
    grams = _gram_hashes(x)
    least = _window_least(grams, n - GRAM + 1)
    whole = np.zeros(len(least) + 1, bool)
    fits = size >= n
    edge = np.zeros(len(least) + 1, np.int32)
    np.add.at(edge, start[fits], 1)
    np.add.at(edge, start[fits] + size[fits] - n + 1, -1)
    whole = np.cumsum(edge)[:-1] > 0
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])  # or the least one was left behind
    change[start[fits]] = True
    change[1:] |= whole[1:] != whole[:-1]
    a = np.flatnonzero(change)
    b = np.append(a[1:], len(least))
    keep = whole[a]
    a, b = a[keep], b[keep]
    up, down = _powers(1 << max(21, int(total + 1).bit_length()))
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(_byte_values()[x] * up[:total], out=sums[1:])
    own = (sums[b + n - 1] - sums[a]) * down[a]
    own = (own ^ (own >> np.uint64(32))) * _M[1]
    text = np.searchsorted(start, a, "right") - 1
    while len(text) and (bad := size[text] == 0).any():  # an empty text starts where its successor does
        text = np.where(bad, text + 1, text)
    return text, a - start[text], b - a, least[a].view(np.int64), own.view(np.int64)


def _byte_slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        if held and n + len(b) > _SLICE:
            yield at, held
            at, held, n = i, [], 0
        held.append(b)
        n += len(b)
    if held:
        yield at, held


# --- two-stage suffix sorting ------------------------------------------------------------------------------


def two_stage_order(x: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """The ``needed`` places of ``x`` in order of their suffixes, compared to at least ``depth`` bytes.

    A suffix smaller than its successor is sorted directly. The others are induced: scanning the first-byte
    buckets upwards, each suffix sends its predecessor, if that is larger, to the next free place of the
    predecessor's bucket; runs of the bucket's own byte are sent on within the bucket. ``needed`` must hold,
    for every place that isn't smaller than its successor, the successor too.
    """
    step = np.sign(np.diff(x.astype(np.int16), append=256))
    turn = np.where(step != 0, np.arange(len(x)), len(x) - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    rising = step[turn] > 0
    direct = np.flatnonzero(needed & rising)
    text = np.concatenate([x, np.zeros(depth, np.uint8)]).tobytes()
    views = np.ndarray(len(x), f"S{depth}", text, strides=(1,))
    direct = direct[np.argsort(views[direct], kind="stable")]
    cut = np.searchsorted(x[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        falling = waiting[c]
        run = np.concatenate(falling) if falling else direct[:0]
        falling = [run] if len(run) else []
        while len(run):
            run = run[run > 0] - 1
            run = run[(x[run] == c) & needed[run]]
            if len(run):
                falling.append(run)
        bucket = np.concatenate([*falling, direct[cut[c] : cut[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(x[before] > c) & needed[before]]
        if len(before):
            first = x[before]
            before = before[np.argsort(first, kind="stable")]
            values, at = np.unique(x[before], return_index=True)
            for v, part in zip(values.tolist(), np.split(before, at[1:]), strict=True):
                waiting[v].append(part)
    return np.concatenate(out) if out else direct


def adjacent_common(x: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix of ``order`` with the one before it, up to ``depth``; the first has none."""
    text = np.concatenate([x, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray(len(x) + depth, np.uint64, text.tobytes(), strides=(1,))
    common = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, depth, 8):
        differ = words[order[live] + at] ^ words[order[live - 1] + at]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        common[live] += equal
        live = live[equal == 8]
    return np.minimum(common, depth)


def repeated_windows(parts: list[bytes], windows: np.ndarray, n: int) -> list[np.ndarray]:
    """For each segment, which of its first ``windows`` places begin ``n`` bytes that also begin elsewhere."""
    windows = np.asarray(windows, np.int64)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    start = np.cumsum(size) - size
    x = np.frombuffer(b"\0".join(parts) + b"\0\xff", np.uint8)
    step = np.sign(np.diff(x.astype(np.int16), append=256))
    turn = np.minimum.accumulate(np.where(step != 0, np.arange(len(x)), len(x) - 1)[::-1])[::-1]
    rises = np.flatnonzero(step[turn] > 0)
    edge = np.zeros(len(x) + 1, np.int32)
    valid = np.zeros(len(x) + 1, np.int32)
    last = start + windows - 1
    np.add.at(edge, start, 1)
    np.add.at(edge, rises[np.searchsorted(rises, last)] + 1, -1)  # on to the next suffix that is sorted directly
    np.add.at(valid, start, 1)
    np.add.at(valid, last + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    order = two_stage_order(x, np.cumsum(edge)[:-1] > 0, n)
    order = order[valid[order]]
    twin = adjacent_common(x, order, n) >= n
    hit = np.zeros(len(x), bool)
    hit[order[twin]] = True
    hit[order[np.flatnonzero(twin) - 1]] = True
    return [hit[s : s + w] for s, w in zip(start.tolist(), windows.tolist(), strict=True)]


# --- the Spark job -----------------------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, n: int = 200, hot_segments: int = 65_536) -> DataFrame:
    """``(k1, k2, spans)``: for each text with repeated windows, the ``[first, last]`` starts of runs of them.

    ``docs``: ``row, text, k1, k2``, the last two naming the text and ``row`` a long that tells its rows apart. A key with over ``hot_segments`` different
    segments is not gathered: its windows are merged one by one instead, which leaves nothing to sort.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [np.asarray(batch.column(i)) for i in (0, 1, 2)]
            for at, raw in _byte_slices(batch.column(3).to_pylist()):
                text, first, windows, key, own = segments(raw, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(own), *(pa.array(v[at + text]) for v in names), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32))],
                    names=["key", "own", "d", "k1", "k2", "first", "windows"],
                )
        give_back()

    shape = "key long, own long, d long, k1 long, k2 long, first int, windows int"
    found = written(docs.select("row", "k1", "k2", "text").mapInArrow(cut, shape), "segments")
    merged = found.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n"))
    keys = merged.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rows")).where("rows > 1")
    alike = merged.join(keys.select("key", "kinds"), "key")
    again = written(found.join(alike, ["key", "own"]), "repeats")

    # the bytes of different segments under one key, taken from the row that each was first seen in
    firsts = again.where("kinds > 1").groupBy("key", "own").agg(F.min(F.struct("d", "k1", "k2", "first", "windows", "kinds")).alias("at")).select("key", "own", "at.*")
    wanted = firsts.groupBy("d", "k1", "k2").agg(F.collect_set(F.struct("key", "own", "first", "windows", (F.col("kinds") > hot_segments).alias("hot"))).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                for w in want:
                    spots = range(w["first"], w["first"] + w["windows"]) if w["hot"] else [w["first"]]
                    for k, spot in enumerate(spots):
                        part = raw[spot : spot + (n if w["hot"] else w["windows"] + n - 1)]
                        for column, value in zip(out, (w["key"], w["own"], k if w["hot"] else -1, len(part) - n + 1, part), strict=True):
                            column.append(value)
                if len(out[0]) > 20_000:
                    yield _parts(out)
                    out = [[], [], [], [], []]
            yield _parts(out)

    def _parts(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["key", "own", "place", "windows", "part"])

    # the texts are dealt by (k1, k2) here and where spans come back to them: one exchange serves both
    texts = docs.join(wanted, ["k1", "k2"]).where(F.col("row") == F.col("d"))
    parts = texts.select("text", "want").mapInArrow(fetch, "key long, own long, place int, windows int, part binary")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bytes_held, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bytes_held > _SLICE * 3 and row[0] != last:  # never within a key
                    yield _repeats(held)
                    held, bytes_held = [], 0
                held.append(row)
                bytes_held += len(row[3])
                last = row[0]
        if held:
            yield _repeats(held)

    def _repeats(held: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([h[3] for h in held], np.array([h[2] for h in held]), n)
        out: list[list] = [[], [], []]
        for (key, own, _, _), flag in zip(held, flags, strict=True):
            if flag.any():
                turns = np.flatnonzero(np.diff(flag.view(np.int8), prepend=0, append=0))
                out[0].append(key)
                out[1].append(own)
                out[2].append([{"a": int(a), "b": int(b) - 1} for a, b in zip(turns[::2], turns[1::2], strict=True)])
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], span)], names=["key", "own", "runs"])

    shape = "key long, own long, runs array<struct<a: int, b: int>>"
    cool = parts.where("place < 0").select("key", "own", "windows", "part").repartition("key").sortWithinPartitions("key").mapInArrow(sort, shape)
    hot = parts.where("place >= 0").select("key", "own", "place", F.xxhash64("part").alias("w"), F.crc32("part").alias("c"))
    twins = hot.groupBy("key", "w", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    warm = hot.join(twins, ["key", "w", "c"]).groupBy("key", "own").agg(F.transform(F.collect_set("place"), lambda p: F.struct(p.alias("a"), p.alias("b"))).alias("runs"))
    alone = again.where("n > 1").groupBy("key", "own").agg(F.max("windows").alias("windows")).select("key", "own", F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).alias("b"))).alias("runs"))
    runs = alone.unionByName(cool).unionByName(warm)
    spans = again.select("key", "own", "k1", "k2", "first").join(runs, ["key", "own"]).select("k1", "k2", F.transform("runs", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b"))).alias("runs"))
    return spans.select("k1", "k2", F.explode("runs").alias("run")).groupBy("k1", "k2").agg(F.collect_set("run").alias("spans"))


def removed_runs(spans: list[dict] | np.ndarray | None, n: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows that start in the spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"] + n) for s in (spans if spans is not None else [])):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, n: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, removed, kept)`` for each row: the byte runs removed, and the UTF-8 bytes left.

    A byte goes if it is covered by an ``n``-byte string that also starts anywhere else in the table, in the same
    text included; strings never cross texts and are judged on the input. Null texts count as empty; texts of
    under ``n`` bytes stay whole. Repeated rows are copies of each other, so both lose all bytes if long enough.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id).alias("row"), F.col(text).alias("text"), F.xxhash64(text).alias("k1"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(-1)).alias("k2"))
    spans = repeated_spans(named, n)

    @F.pandas_udf("n_bytes long, removed array<struct<start: int, end: int>>, kept binary")
    def apply(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, found, strict=True):
            raw = (t or "").encode()
            runs = removed_runs(s, n)
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            rows.append((len(raw), [{"start": a, "end": b} for a, b in runs], b"".join([*kept, raw[at:]])))
        return pd.DataFrame(rows, columns=["n_bytes", "removed", "kept"])

    return named.join(spans, ["k1", "k2"], "left").select("doc_id", apply("text", "spans").alias("r")).select("doc_id", "r.*")


def digest(removed: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of ``without_repeats``' rows."""
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return removed.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], n: int) -> list[tuple[int, int, int, str]]:
    """The same by a dictionary of all windows, for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(gone.view(np.int8), prepend=0) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out
