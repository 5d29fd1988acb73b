"""Benchmark passages in documents: q-gram lemma filter in diagonal bands, then banded alignment.

Texts are compared as lower-case letters and digits with single blanks between words. Each benchmark item is
cut into overlapping probes of ``length`` characters, and of ``SHORT`` characters every ``STRIDE``: a verbatim
excerpt of ``SHORT + STRIDE - 1`` = 70 such characters holds a whole short probe wherever it starts. An occurrence of a probe with at most ``e`` edits shares
``length + 1 - q * (e + 1)`` of its q-grams, on diagonals (text place less probe place) at most ``e`` apart.
Shared q-grams are counted in bands of 16 diagonals that overlap by ``e``; bands that reach the bound are
aligned, and a probe within its edit budget makes the document a hit of its item. Items shorter than a q-gram are
found where they stand as whole words, without edits. Long texts go through in windows that overlap by more than a
probe, so what a task holds is bounded whatever the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoa.llm import codepoints as cp
from stoa.llm.memory import give_back, small_batches
from stoa.session import written

BAND = 16
SHORT, STRIDE = 64, 7
SLICE_CHARS = 1 << 16  # each place of a benchmark passage meets some ten probes
ENTRIES = 1 << 21  # of places with probes that are held at once
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(characters, place of each in the joined texts, each text's first, each text's first in the joined)``; 0 ends a text."""
    points, starts = cp.joined(texts)
    alpha, lower = cp.letters()
    low = np.where(alpha[points], lower[points], np.where(cp.digits()[points], points, 32)).astype(np.uint32)
    low[starts[1:] - 1] = 0
    keep = low != 32
    keep[1:] |= low[:-1] > 32  # the first blank after a word
    at = np.flatnonzero(keep)
    return low[at], at, np.searchsorted(at, starts[:-1]), starts


def qgram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """A hash of the ``q`` characters from each place on, from hashes of powers of two of them."""
    size = len(x) - q + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h, width, out, done = cp.mixed(x.astype(np.uint64) * _P[0] + _P[3]), 1, None, 0
    while done < q:
        if q & width:
            part = h[done : done + size]
            out = part.copy() if out is None else out * _P[2] + part
            done += width
        if done < q:
            h = h[:-width] * _P[1] + h[width:]
            h ^= h >> np.uint64(29)
            width *= 2
    return cp.mixed(out)


@dataclass
class Probes:
    """Probes of a block of benchmark items and the index of their q-grams."""

    item: np.ndarray
    short: np.ndarray
    chars: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    probe: np.ndarray
    place: np.ndarray
    q: int
    tiny: dict[int, tuple[np.ndarray, np.ndarray]]

    @property
    def reach(self) -> int:
        """Characters that an occurrence may take, with room for its band."""
        return max([0, *map(len, self.chars)]) + 4 * BAND + 4 * int(self.budget.max(initial=0)) + self.q

    @cached_property
    def table(self) -> np.ndarray:
        """By a hash's high bits: whether any q-gram has them. Built where it is used, once a task."""
        out = np.zeros(1 << 22, bool)
        out[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        return out

    @classmethod
    def of(cls, items: list[tuple[int, str]], q: int, length: int, errors: float) -> Probes:
        """Probes start every half length, short ones every ``STRIDE``; the last of each ends with the item.

        An item of fewer than ``q`` characters is kept whole instead, by its length.
        """
        item, chars, short = [], [], []
        whole: dict[int, list[tuple[int, int]]] = {}
        for key, text in items:
            x = normalised([text or ""])[0]
            x = x[x != 0]
            x = x[:-1] if len(x) and x[-1] == 32 else x
            if len(x) < q:
                if len(x):
                    whole.setdefault(len(x), []).append((int(qgram_hashes(x, len(x))[0]), key))
                continue
            for wide, step in ((length, max(1, length // 2)), *[(SHORT, STRIDE)] * (SHORT < min(length, len(x)))):
                size = min(wide, len(x))
                for s in sorted({*range(0, len(x) - size + 1, step), len(x) - size}):
                    item.append(key)
                    chars.append(x[s : s + size])
                    short.append(wide < length)
        sizes = np.array([len(c) for c in chars], np.int64)
        budget = np.minimum((sizes * errors).astype(np.int64), np.maximum(0, (sizes - q) // q))
        hashes = [qgram_hashes(c, q) for c in chars]
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        probe = np.repeat(np.arange(len(chars)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        tiny = {n: (np.array([h for h, _ in sorted(own)], np.uint64), np.array([k for _, k in sorted(own)], np.int64)) for n, own in whole.items()}
        return cls(np.array(item, np.int64), np.array(short, bool), chars, budget, sizes + 1 - q * (budget + 1), grams, np.append(first, len(flat)), probe[order], place[order], q, tiny)


def banded_distance(probe: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of ``probe`` (a row each) against any part of its window that stays in the band, and where it ends.

    Column ``d`` of the band is the diagonal ``d`` places right of the window's start.
    """
    count, size = probe.shape
    band = windows.shape[1] - size + 1
    steps = np.arange(band)
    cost = np.zeros((count, band), np.int32)
    for i in range(size):
        across = cost + (windows[:, i : i + band] != probe[:, i : i + 1])
        across[:, :-1] = np.minimum(across[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(across - steps, 1) + steps
    return cost.min(1), cost.argmin(1) + size


Found = dict[tuple[int, int], tuple[bool, int, int, int]]  # by text and item: by a short probe, edits, start, end


def _merge(into: Found, more: Found, text: int, at: int) -> None:
    for (t, item), (short, edits, start, end) in more.items():
        found = (short, edits, start + at, end + at)
        into[t + text, item] = min(into.get((t + text, item), found), found)


def _windowed(text: str, probes: Probes, size: int, depth: int = 0) -> Found:
    """The hits of one long text, by windows of ``size`` characters that overlap by what an occurrence may take."""
    best: Found = {}
    at, wide = 0, size
    while True:
        piece = text[at : at + wide]
        kept = normalised([piece])[1][:-1]
        last = at + wide >= len(text)
        if not last and len(kept) <= 2 * probes.reach:  # mostly blanks and symbols: more of it
            wide *= 2
            continue
        _merge(best, _best_in([piece], probes, max(size, len(piece)), depth), 0, at)
        if last:
            return best
        at, wide = at + int(kept[-probes.reach - 1]), size


def _whole_words(x: np.ndarray, at: np.ndarray, first: np.ndarray, starts: np.ndarray, probes: Probes) -> Found:
    """Items of under ``q`` characters that stand as whole words."""
    best: Found = {}
    for n, (hashes, items) in probes.tiny.items():
        h = qgram_hashes(x, n)
        spot = np.flatnonzero(np.isin(h, hashes))
        spot = spot[((spot == 0) | (x[spot - 1] <= 32)) & (x[spot + n] <= 32)] if len(spot) else spot
        text = np.searchsorted(first, spot, "right") - 1
        for t, own, s in sorted({(int(t), int(k), int(s)) for t, k, s in zip(text, h[spot], spot, strict=True)}, reverse=True):
            for item in items[np.searchsorted(hashes, np.uint64(own)) : np.searchsorted(hashes, np.uint64(own), "right")].tolist():
                best[t, item] = (False, 0, int(at[s] - starts[t]), int(at[s + n - 1] + 1 - starts[t]))
    return best


def _best_in(texts: list[str], probes: Probes, size: int, depth: int = 0) -> Found:
    """The best probe of each item found in each text; probes of full length go before short ones."""
    if len(texts) == 1 and len(texts[0]) > size:
        return _windowed(texts[0], probes, size, depth)
    q = probes.q
    x, at, first, starts = normalised(texts)
    best = _whole_words(x, at, first, starts, probes) if probes.tiny else {}
    h = qgram_hashes(x, q)
    if not len(h) or not len(probes.grams):
        return best
    spot = np.flatnonzero(probes.table[(h >> np.uint64(42)).astype(np.int64)])
    k = np.minimum(np.searchsorted(probes.grams, h[spot]), len(probes.grams) - 1)
    same = probes.grams[k] == h[spot]
    spot, k = spot[same], k[same]
    many = probes.first[k + 1] - probes.first[k]
    if int(many.sum()) > ENTRIES:  # q-grams that many probes share: in smaller parts
        if len(texts) > 1:
            half = len(texts) // 2
            for part, own in ((0, texts[:half]), (half, texts[half:])):
                _merge(best, _best_in(own, probes, size, depth), part, 0)
            return best
        if len(x) > 16 * probes.reach and depth < 6:
            _merge(best, _windowed(texts[0], probes, len(texts[0]) // 4, depth + 1), 0, 0)
            return best
    entry = np.repeat(probes.first[k] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    spot = np.repeat(spot, many)
    probe, place = probes.probe[entry], probes.place[entry]
    shift = max(256, max(map(len, probes.chars)))
    diagonal = spot - place + shift  # positive
    low = diagonal % BAND < probes.budget[probe]  # also in the band before
    probe, place, band = np.concatenate([probe, probe[low]]), np.concatenate([place, place[low]]), np.concatenate([diagonal // BAND, diagonal[low] // BAND - 1])
    if not len(probe):
        return best
    wide = int(band.max()) + 1
    places = int(place.max()) + 1
    seen = np.unique((probe * wide + band) * places + place)
    key, shared = np.unique(seen // places, return_counts=True)
    key = key[shared >= probes.bound[key // wide]]
    probe, left = key // wide, (key % wide) * BAND - shift
    padded = np.concatenate([np.zeros(2 * shift, np.uint32), x, np.zeros(2 * shift + 64, np.uint32)])
    sizes = np.array([len(c) for c in probes.chars])
    for size_, e in {(int(sizes[p]), int(probes.budget[p])) for p in probe}:
        some = np.flatnonzero((sizes[probe] == size_) & (probes.budget[probe] == e))
        for chunk in np.array_split(some, -(-len(some) // 4096)):
            start = left[chunk] - e
            cells = start[:, None] + 2 * shift + np.arange(size_ + BAND + 3 * e)
            edits, end = banded_distance(np.stack([probes.chars[p] for p in probe[chunk]]), padded[cells])
            for c in np.flatnonzero(edits <= e).tolist():
                stop = int(min(max(start[c] + end[c], 1), len(x)))
                begin = max(0, stop - size_)
                text = int(np.searchsorted(first, max(stop - 1, 0), "right") - 1)
                begin = max(begin, int(first[text]))
                name = (text, int(probes.item[probe[chunk[c]]]))
                found = (bool(probes.short[probe[chunk[c]]]), int(edits[c]), int(at[begin] - starts[text]), int(at[stop - 1] + 1 - starts[text]))
                best[name] = min(best.get(name, found), found)
    return best


def hits_in(texts: list[str], probes: Probes) -> list[tuple[int, int, int, int, int]]:
    """``(text, item, start, end, edits)`` of the best place of each item found in each text; offsets in characters."""
    return [(t, i, s, e, d) for (t, i), (_, d, s, e) in sorted(_best_in(texts, probes, SLICE_CHARS).items())]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, q: int, length: int, errors: float, block_chars: int) -> Iterator[tuple[Probes, pa.Array]]:
    """Probes of one block of items after another, and the ids of the items by their number in the block."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_chars))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        pairs = sorted({(r["i"] is None, r["i"] or 0, r["t"]) for r in own})
        # an item's rows share a number; without an id each text has its own
        names = sorted({(none, i, t if none else "") for none, i, t in pairs})
        number = {name: k for k, name in enumerate(names)}
        ids = pa.array([None if none else i for none, i, _ in names], pa.int64())
        yield Probes.of([(number[none, i, t if none else ""], t) for none, i, t in pairs], q, length, errors), ids


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   q: int = 12, length: int = 100, errors: float = 0.05, block_chars: int = 800_000) -> DataFrame:
    """``(doc_id, item_id, start, end, edits)``: for each row of ``docs`` and item found in it, the best place.

    Verbatim excerpts of 70 characters, as compared, are always found; shorter ones may be missed, but items of under
    ``q`` characters are found as whole words. Null texts, and items without a letter or digit, give nothing; items
    without an id give hits with none; repeated rows repeat their hits. The benchmark goes out in blocks of about
    ``block_chars`` characters, one pass over the documents each, so what a task holds is bounded however long it is.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    shape = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, item_id long, start int, end int, edits int"

    def one(probes: Probes, ids: pa.Array) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, some in cp.slices((t.as_py() for t in batch.column(1)), SLICE_CHARS):
                    hits = hits_in(some, probes)
                    rows = pa.array([at + h[0] for h in hits], pa.int64())
                    item = ids.take(pa.array([h[1] for h in hits], pa.int64()))
                    rest = [pa.array([h[k] for h in hits], pa.int32()) for k in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), item, *rest], names=["doc_id", "item_id", "start", "end", "edits"])
            give_back()

        return narrow.mapInArrow(search, shape)

    return reduce(DataFrame.unionByName, [one(*b) for b in _blocks(benchmark, item_id, item_text, q, length, errors, block_chars)])


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                      q: int = 12, length: int = 100, errors: float = 0.05, block_chars: int = 800_000) -> DataFrame:
    """``docs`` less the rows with a hit, each row judged on its own: ids, repeats and other columns don't matter.

    One pass over the rows; a benchmark of more blocks takes one each, over what the one before left.
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)
    for k, (probes, _) in enumerate(_blocks(benchmark, item_id, item_text, q, length, errors, block_chars)):
        docs = written(docs, "clean") if k else docs

        def clean(batches: Iterator[pa.RecordBatch], probes: Probes = probes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, some in cp.slices((t.as_py() for t in batch.column(place)), SLICE_CHARS):
                    keep[[at + h[0] for h in hits_in(some, probes)]] = False
                yield batch.filter(pa.array(keep))
            give_back()

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
