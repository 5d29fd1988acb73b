"""Language spans: script ranges narrow the languages, then Viterbi over words with a penalty for each switch.

A word's score for a language is the sum of its character trigrams' log probabilities. Languages that hardly
use the word's script are out, unless none uses it. The best path over a text's words, where each change of
language costs ``switch``, gives spans; the language with most letters is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.llm import codepoints as cp
from stoa.llm.memory import give_back, small_batches
from stoa.session import free_name

GRAM_BITS = 16
# First code point of each range, and the script from there on (Unicode block bounds).
SCRIPT_STARTS = (0, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3190, 0x31F0, 0x3200, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00)
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "indic", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "kana", "han", "hangul", "han", "kana", "other", "han", "other", "hangul", "other", "han", "other")
_NAMES = sorted(set(SCRIPTS))
_IDS = np.array([_NAMES.index(s) for s in SCRIPTS])


def _scripts(points: np.ndarray) -> np.ndarray:
    return _IDS[np.searchsorted(SCRIPT_STARTS, points, "right") - 1]


def _grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word starts, word ends, bucket of the trigram around each character)``; outside a word all is blank."""
    alpha, lower = cp.letters()
    a, b = cp.word_spans(points)
    low = np.where(alpha[points], lower[points], 32).astype(np.uint64)
    before, after = np.concatenate([[32], low[:-1]]).astype(np.uint64), np.concatenate([low[1:], [32]]).astype(np.uint64)
    h = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (low * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
    return a, b, (cp.mixed(h) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, log probabilities (bucket, language) and which languages use a script (script, language)."""

    langs: list[str]
    scores: np.ndarray
    uses: np.ndarray


def train(rows: DataFrame, text: str = "text", lang: str = "lang", rare: float = 0.001) -> LanguageModel:
    """A model from all rows with a text and a language: trigram and script counts are summed by Spark.

    What reaches the driver is at most 65,536 counts a language. A script of under ``rare`` of a language's
    letters counts as unused by it. Without training rows there is no language and every text is ``und``.
    """
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for name, own in frame.groupby("l"):
                table = seen.setdefault(name, np.zeros((1 << GRAM_BITS) + len(_NAMES), np.int64))
                for _, some in cp.slices(own["t"].tolist()):
                    points, _ = cp.joined(some)
                    _, _, gram = _grams(points)
                    alpha = cp.letters()[0][points]
                    table[: 1 << GRAM_BITS] += np.bincount(gram[alpha], minlength=1 << GRAM_BITS)
                    table[1 << GRAM_BITS :] += np.bincount(_scripts(points[alpha]), minlength=len(_NAMES))
        for name, table in seen.items():
            hit = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(hit), pa.array(table[hit])], names=["l", "k", "n"])

    got = rows.mapInArrow(count, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(got["l"].unique())
    table = np.zeros(((1 << GRAM_BITS) + len(_NAMES), len(langs)))
    table[got["k"], np.searchsorted(langs, got["l"]) if langs else []] = got["n"]
    grams, script = table[: 1 << GRAM_BITS], table[1 << GRAM_BITS :]
    scores = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * (1 << GRAM_BITS))) if langs else grams
    return LanguageModel(langs, scores.astype(np.float32), script >= rare * np.maximum(1, script.sum(0)))


def viterbi(scores: np.ndarray, docs: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word. ``scores``: (word, language); ``docs``: each word's document, ascending.

    All documents advance together, one word a step, so the steps are those of the longest.
    """
    n, langs = scores.shape
    path = np.zeros(n, np.int64)
    if not n:
        return path
    first = np.flatnonzero(np.diff(docs, prepend=docs[0] - 1))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    live = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # documents longer than t
    best = scores[first].astype(np.float64)
    back = np.zeros((n, langs), np.int8 if langs < 128 else np.int32)
    for t in range(1, int(length[0])):
        k = live[t]
        top = best[:k].argmax(1)
        gain = best[np.arange(k), top] - switch
        stay = best[:k] >= gain[:, None]
        at = first[:k] + t
        back[at] = np.where(stay, np.arange(langs), top[:, None])
        best[:k] = np.where(stay, best[:k], gain[:, None]) + scores[at]
    state = best.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        k = live[t]
        at = first[:k] + t
        path[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return path


def label_column(model: LanguageModel, text: Column, switch: float = 12.0) -> Column:
    """A struct of ``lang``, ``score`` (its share of the letters) and ``spans``: character offsets and language."""

    @F.pandas_udf("lang string, score double, spans array<struct<start: int, end: int, lang: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([*model.langs, "und"], object)
        unused = np.where(model.uses, 0, -1e4).astype(np.float32)
        unused[~model.uses.any(1)] = 0
        for batch in batches:
            langs, scores, spans = [], [], []
            for _, some in cp.slices(batch.tolist()):
                points, starts = cp.joined(some)
                a, b, gram = _grams(points)
                doc = np.searchsorted(starts, a, "right") - 1
                if len(a) and model.langs:
                    alpha = np.flatnonzero(cp.letters()[0][points])
                    by_word = np.add.reduceat(model.scores[gram[alpha]], np.cumsum(b - a) - (b - a))
                    path = viterbi(by_word + unused[_scripts(points[a])], doc, switch)
                else:
                    path = np.full(len(a), len(model.langs))
                share = np.bincount(doc * len(names) + path, b - a, len(some) * len(names)).reshape(len(some), -1)
                share[:, -1] += share.sum(1) == 0
                top = share.argmax(1)
                langs += names[top].tolist()
                scores += np.where(top == len(model.langs), 0.0, share.max(1) / share.sum(1)).tolist()
                cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
                last = np.append(cut[1:], len(a)) - 1
                own = [[] for _ in some]
                for d, s, e, x in zip(doc[cut].tolist(), (a[cut] - starts[doc[cut]]).tolist(), (b[last] - starts[doc[cut]]).tolist() if len(cut) else [], names[path[cut]].tolist(), strict=True):
                    own[d].append({"start": s, "end": e, "lang": x})
                spans += own
            yield pd.DataFrame({"lang": langs, "score": np.array(scores, float), "spans": spans})
        give_back()

    return run(text)


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", switch: float = 12.0) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans``, named longer where ``docs`` has such a column.

    A null text, or one without a letter, is ``und`` with score 0 and no span. Each row is labelled on its own.
    """
    small_batches(docs.sparkSession)
    held = free_name(docs, "_language")
    out = docs.withColumn(held, label_column(model, F.col(text), switch))
    return out.select(
        *[out[c] for c in docs.columns],
        out[held]["lang"].alias(free_name(docs, "lang_pred")),
        out[held]["score"].alias(free_name(docs, "score")),
        out[held]["spans"].alias(free_name(docs, "spans")),
    )
