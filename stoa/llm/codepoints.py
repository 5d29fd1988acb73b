"""Texts as arrays of code points: words, their hashes, and slices of bounded size, all vectorised."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

SLICE_CHARS = 1 << 18  # a task holds some tens of bytes a character of one slice
_SPACE = re.compile(r"\s")
_BREAK = 10  # between two documents: a line feed, which is in no word


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """``(is a letter, its lower case)`` for every code point; a case pair that isn't one to one keeps its form."""
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(alpha).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return alpha, lower


@cache
def digits() -> np.ndarray:
    return np.fromiter((chr(i).isdigit() for i in range(0x110000)), bool, 0x110000)


def slices(texts: Iterable[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """``(first index, texts)`` in runs of about ``chars`` characters; null is empty. A longer text is a run of its own."""
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and n + len(t) > chars:
            yield at, held
            at, held, n = i, [], 0
        held.append(t)
        n += len(t)
    if held:
        yield at, held


def pieces(text: str, chars: int = SLICE_CHARS) -> Iterator[tuple[int, str]]:
    """``(place, part)`` of a text in parts of about ``chars`` characters, cut before white space: no word is broken."""
    at = 0
    while len(text) - at > chars:
        cut = max(text.rfind(" ", at + 1, at + chars), text.rfind("\n", at + 1, at + chars))
        if cut < 0:
            later = _SPACE.search(text, at + chars)
            cut = later.start() if later else len(text)
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points with a break after each, and where each text starts (one more entry at the end)."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    return points, starts


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of letters."""
    alpha = letters()[0][points]
    edge = np.diff(alpha.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@cache
def _salts() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads the high bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, by its code points and their places."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    chars = points[np.repeat(starts, lengths) + place].astype(np.uint64)
    terms = mixed(chars * np.uint64(0x9E3779B97F4A7C15)) * _salts()[place & 0xFFFF]
    return mixed(np.add.reduceat(terms, first))


def prefix_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: the spans at least that long, and a hash of their first characters."""
    out, h = [], np.zeros(len(starts), np.uint64)
    keep = np.arange(len(starts))
    for k in range(max(sizes)):
        keep = keep[ends[keep] - starts[keep] > k]
        chars = points[starts[keep] + k].astype(np.uint64)
        h[keep] += mixed(chars * np.uint64(0x9E3779B97F4A7C15)) * _salts()[k]
        if k + 1 in sizes:
            out.append((keep, mixed(h[keep] + np.uint64(k + 1))))
    return out
