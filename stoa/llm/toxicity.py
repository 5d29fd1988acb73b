"""Toxicity by multiple-instance learning: a document is a bag of sentences, and toxic if any of them is.

Each sentence has a logistic score over its words and word beginnings; a document's score is their noisy-or,
``1 - prod(1 - p)``. Weights are fitted to document labels alone, and the sentence scores then say where the
offence is. Corpus counts cover all labelled training rows; the fit takes a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.llm import codepoints as cp
from stoa.llm.memory import give_back, small_batches
from stoa.session import free_name

BUCKET_BITS = 20
PREFIXES = (4, 5, 6)
_ENDS = np.zeros(0x110000, bool)
_ENDS[[ord(c) for c in ".!?\n\r。！？…"]] = True


def _sentence_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(feature bucket, its sentence, sentence starts, sentence ends, document of each sentence)``."""
    points, starts = cp.joined(texts)
    lower = cp.letters()[1][points]
    a, b = cp.word_spans(points)
    cuts = np.flatnonzero(_ENDS[points]) + 1  # each document's closing break is one
    sentence = np.searchsorted(cuts, a, "right")
    s_start = np.concatenate([[0], cuts[:-1]])
    doc = np.searchsorted(starts, s_start, "right") - 1
    shift = np.uint64(64 - BUCKET_BITS)
    found, where = [cp.word_hashes(lower, a, b) >> shift], [sentence]
    for keep, h in cp.prefix_hashes(lower, a, b, PREFIXES):
        found.append(h >> shift)
        where.append(sentence[keep])
    return np.concatenate(found).astype(np.int64), np.concatenate(where), s_start - starts[doc], cuts - starts[doc], doc


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the feature buckets that count, and a sentence's bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS, np.float64)
        out[self.buckets] = self.weights
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each bucket, by label: one dense table a task, whatever the rows."""
    seen = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        labels = np.asarray(batch.column(1)).astype(np.int64)
        for at, some in cp.slices(t.as_py() for t in batch.column(0)):
            bucket, sentence, _, _, doc = _sentence_words(some)
            pairs = np.unique(doc[sentence] << BUCKET_BITS | bucket)
            toxic = labels[at + (pairs >> BUCKET_BITS)]
            for y in (0, 1):
                seen[y] += np.bincount(pairs[toxic == y] & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
    hit = np.flatnonzero(seen.sum(0))
    for k in range(0, len(hit), 1 << 16):
        part = hit[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0, part]), pa.array(seen[1, part])], names=["bucket", "n0", "n1"])
    del seen
    give_back()


def _fit(bags: pa.Table, k: int, start: np.ndarray, steps: int, decay: float) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or's log loss. A bag: label, sentences without features, (sentence, feature) pairs by
    sentence, and how many rows it stands for."""
    many = bags["n"].to_numpy().astype(float)
    y = bags["y"].to_numpy().astype(float)
    plain = bags["plain"].to_numpy().astype(float)
    pairs = np.cumsum(pc.list_value_length(bags["s"]).to_numpy().astype(np.int64))
    row, col = (pc.list_flatten(bags[c]).to_numpy().astype(np.int64) for c in ("s", "k"))
    sizes = np.diff(pairs, prepend=0)
    own = np.zeros(len(y), np.int64)
    own[sizes > 0] = row[pairs[sizes > 0] - 1] + 1  # sentences with features
    base = np.concatenate([[0], np.cumsum(own)])
    row += np.repeat(base[:-1], sizes)
    bag = np.repeat(np.arange(len(y)), own)
    w = np.concatenate([start, [-6.0]])
    m = v = np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], base[-1]) + w[k]
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-w[k]))
        quiet = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + plain * np.log1p(-p0)
        doc = np.clip(1 - np.exp(quiet), 1e-7, 1 - 1e-7)
        pull = many * (1 - y / doc)  # of the loss, by a sentence's logit, over p
        g_row = pull[bag] * p
        grad = np.bincount(col, g_row[row], k + 1)
        grad[k] = g_row.sum() + (pull * plain).sum() * p0
        grad = grad / max(1.0, many.sum()) + decay * np.concatenate([w[:k], [0]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:k], float(w[k])


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", features: int = 2048, sample: int = 12_000, steps: int = 300, decay: float = 1e-5) -> ToxicityModel:
    """A model from rows with a text and a 0/1 label; rows where either is null are left out.

    Buckets are chosen by their counts over all rows: the ``features`` with the largest difference of log odds
    times the root of their toxic documents. About ``sample`` rows (of a larger table, the texts whose hash falls
    in that share; copies of a text come together and count as often) are used to fit the weights. Spark makes
    their features and merges equal ones, and those come to the driver: not over ``sample`` different ones but for
    chance. With no toxic row, or no row at all, the model has no features and scores every text near zero.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y")).where("t is not null and y in (0, 1)")
    counts = rows.mapInArrow(_counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = rows.agg(F.count(F.when(F.col("y") == 0, 1)).alias("n0"), F.count(F.when(F.col("y") == 1, 1)).alias("n1")).first()
    odds = F.log((F.col("n1") + 0.5) / (n["n1"] + 1.0)) - F.log((F.col("n0") + 0.5) / (n["n0"] + 1.0))
    best = (
        counts.where("n1 >= 2").select("bucket", odds.alias("odds"), (odds * F.sqrt("n1")).alias("z")).where("odds > 1")
        .orderBy(F.desc("z"), "bucket").limit(features).collect()
    )
    if not best:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -12.0)
    chosen = np.array([r["bucket"] for r in best], np.int64)
    order = np.argsort(chosen)
    chosen = chosen[order]
    start = np.array([min(2.0, r["odds"] / 4) for r in best])[order]

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            out: list[list] = [[], [], [], []]
            for at, some in cp.slices(t.as_py() for t in batch.column(0)):
                bucket, sentence, s_start, _, doc = _sentence_words(some)
                k = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
                hit = chosen[k] == bucket
                pairs = np.unique(sentence[hit] * len(chosen) + k[hit])
                s, k = pairs // len(chosen), pairs % len(chosen)
                total = np.bincount(doc, minlength=len(some))
                for i in range(len(some)):
                    own = slice(*np.searchsorted(doc[s], [i, i + 1]))
                    rows, at_row = np.unique(s[own], return_inverse=True)
                    out[0].append(labels[at + i])
                    out[1].append(int(total[i]) - len(rows))
                    out[2].append(at_row.tolist())
                    out[3].append(k[own].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int32()))],
                names=["y", "plain", "s", "k"],
            )

    share = min(1.0, sample / max(1, n["n0"] + n["n1"]))
    some = rows.where(F.pmod(F.xxhash64("t", F.lit(10)), F.lit(1_000_000)) < round(share * 1_000_000))
    made = some.mapInArrow(bags, "y int, plain long, s array<int>, k array<int>")
    drawn = made.groupBy("y", "plain", "s", "k").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "plain", "s", "k")
    weights, bias = _fit(drawn.toArrow(), len(chosen), start, steps, decay)
    return ToxicityModel(chosen, weights, bias)


def score_column(model: ToxicityModel, text: Column, report: float = 0.3) -> Column:
    """A struct of ``score`` and ``sentences``: the spans (character offsets) whose own score is at least ``report``."""

    @F.pandas_udf("score double, sentences array<struct<start: int, end: int, score: double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        dense = model.dense()
        p0 = 1 / (1 + np.exp(-model.bias))
        for batch in batches:
            scores, spans = np.zeros(len(batch)), [[] for _ in range(len(batch))]
            for at, some in cp.slices(batch.tolist()):
                bucket, sentence, a, b, doc = _sentence_words(some)
                hit = dense[bucket] != 0
                pairs = np.unique(sentence[hit] << BUCKET_BITS | bucket[hit])
                z = np.bincount(pairs >> BUCKET_BITS, dense[pairs & ((1 << BUCKET_BITS) - 1)], len(doc)) + model.bias
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                p[np.bincount(pairs >> BUCKET_BITS, minlength=len(doc)) == 0] = p0
                quiet = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(some))
                scores[at : at + len(some)] = np.clip(1 - np.exp(quiet), 0, 1)
                for s in np.flatnonzero(p >= report).tolist():
                    spans[at + int(doc[s])].append({"start": int(a[s]), "end": int(b[s]), "score": float(p[s])})
            yield pd.DataFrame({"score": scores, "sentences": spans})
        give_back()

    return run(text)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``sentences``, named longer where ``docs`` has such a column.

    A null or empty text has the score of one sentence without features. Each row is scored on its own.
    """
    small_batches(docs.sparkSession)
    score = free_name(docs, "score")
    held = free_name(docs, "_toxicity")
    out = docs.withColumn(held, score_column(model, F.col(text)))
    return out.select(
        *[out[c] for c in docs.columns],
        out[held]["score"].alias(score),
        (out[held]["score"] >= threshold).cast("int").alias(free_name(docs, "predicted")),
        out[held]["sentences"].alias(free_name(docs, "sentences")),
    )
