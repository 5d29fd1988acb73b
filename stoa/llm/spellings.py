"""Spelling variants: words one edit apart, found by bands of a letter-parity bitmask.

Each letter has a bit; a word's mask holds the parities of its letters' counts. An inserted or deleted code point flips at
most one bit, a replaced one at most two, so of three bands of the mask one is untouched. Words meet by an equal band and a
length (the longer of two also under the length before its own), and are verified: masks first, then the words themselves.

Millions of words may share a band, so a band is cut finer by what one edit can't change either: with ``l`` the shorter
length, the first or the last ``l // 2`` code points of both words agree. A key is a band, a length and one of these
halves, six keys a word. Candidates don't leave the join; a pair is taken under the first key that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.session import cut, written

#: letters by how often they occur in European text, dealt in turn to the three bands, so each band tells much
LETTERS = "etaoinsrhdlucmfwygpbvkjxqz"
BANDS, BAND_BITS = 3, 21


def _bit(code_point: int) -> int:
    """The mask's bit of a lower-case letter or of another code point, which shares one."""
    place = LETTERS.find(chr(code_point))
    place = place if place >= 0 else 26 + code_point % (BANDS * BAND_BITS - 26)
    return place % BANDS * BAND_BITS + place // BANDS


_BITS = np.array([_bit(c) for c in range(0x100)])


def letter_mask(word: str) -> int:
    """The parities of a word's letters, 63 bits."""
    mask = 0
    for c in word:
        mask ^= 1 << int(_BITS[ord(c) & 0xFF])
    return mask


def mask_column(word: Column) -> Column:
    """``letter_mask`` as a vectorised column."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield pd.Series([letter_mask(w) for w in words], dtype="int64")

    return run(word)


def band_masks() -> list[int]:
    return [((1 << BAND_BITS) - 1) << (band * BAND_BITS) for band in range(BANDS)]


def lower_ascii(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(word)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5, thinned: int = 199) -> DataFrame:
    """``word, n`` of runs of Latin letters of ``shortest`` code points or more that occur ``least`` times or more over all texts.

    Where ``thinned`` divides the crc32 of ``<doc_id>:<run>``, the code point at that number modulo the run's length is taken out
    first: a reproducible misspelling in some documents. Without ``thinned`` (0) runs stay as they are.
    """
    # a run shorter than the shortest word can't become one
    found = F.regexp_extract_all(text, F.lit(rf"[A-Za-zÀ-ÿ]{{{shortest},}}"), 0)
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), found.alias("runs")).select("id", F.explode_outer("runs").alias("run")).where("run is not null")
    runs = runs.select("id", lower_ascii(F.col("run")).alias("word"))
    if thinned:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(h, F.length("word")).cast("int")
        shorter = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2, F.length("word")))
        runs = runs.select(F.when(h % thinned == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b`` with ``a_n, b_n``: pairs of words (``word, n``, words distinct) exactly one edit apart, each once."""
    bands = band_masks()
    words = written(words.withColumn("mask", mask_column(F.col("word"))).withColumn("len", F.length("word")), "words")
    half = F.floor(F.col("meet") / 2).cast("int")
    ends = [F.substr("word", F.lit(1), half), F.substr("word", F.length("word") - half + 1, half)]
    keys = F.array(*[F.struct(F.lit(2 * k + e).alias("turn"), F.xxhash64(F.lit(2 * k + e), "meet", F.col("mask").bitwiseAND(F.lit(m)), end).alias("key")) for k, m in enumerate(bands) for e, end in enumerate(ends)])

    def side(s: str, meet: Column) -> DataFrame:
        laid = words.select("*", F.explode(meet).alias("meet"))
        laid = laid.select("*", keys.alias("_keys")).select("*", F.explode("_keys").alias("k"))
        return laid.select(F.col("k.key").alias("key"), F.col("k.turn").alias("turn"), "meet", *[F.col(c).alias(f"{s}_{c}") for c in ("word", "n", "mask", "len")])

    a, b = side("a", F.array("len")), side("b", F.array(F.col("len"), F.col("len") - 1))
    apart = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    same = F.col("a_len") == F.col("b_len")
    met = a.join(b, ["key", "turn", "meet"]).where((F.bit_count(apart) <= F.when(same, 2).otherwise(1)) & (~same | (F.col("a_word") < F.col("b_word"))) & (F.levenshtein("a_word", "b_word", 1) == 1))
    begun = F.substr("a_word", F.lit(1), half) == F.substr("b_word", F.lit(1), half)
    first = F.lit(-1)
    for k in reversed(range(BANDS)):
        first = F.when(apart.bitwiseAND(F.lit(bands[k])) == 0, 2 * k).otherwise(first)
    return met.where(F.col("turn") == first + F.when(begun, 0).otherwise(1)).select(F.col("a_word").alias("a"), F.col("b_word").alias("b"), "a_n", "b_n")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """``word, n, form, form_n, n_near, root`` of ``words`` (``word, n``; words distinct, not null).

    ``n_near`` counts the words one edit away. The ``form`` is the most frequent of these (ties to the smaller in code-point
    order) if it is at least ``times`` as frequent; the ``root`` is the last of the word's chain of forms, or the word. Chains
    are followed by doubling; frequencies grow along them, so they end. An empty table gives no row.
    """
    words = written(words, "counted")
    pairs = written(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("top"))
    told = words.join(best, "word", "left")
    formed = -F.col("top.m") >= times * F.col("n")
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("top.other")).alias("form"), F.when(formed, -F.col("top.m")).alias("form_n")), "forms")
    roots = cut(told.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = cut(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
