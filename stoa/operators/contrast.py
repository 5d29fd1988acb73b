"""Contrastive scores of paired features, batch by batch, without a batch's table of all similarities.

A batch's rows are cut into parts; each part of one side meets each part of its batch's other side once, block by block, and leaves
for every row and column the largest logit and the sum of exponentials below it. Such pairs merge in any order, so
log-sums of batches of any size come out of sums by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.session import written

_PART = "batch long, side int, item long, top double, total double, own double, cross double"


def _partial(scale: float, bias: float, block: int):
    """Rows (``batch, left, right, side, item, v``) come in order of these: of each meeting first the left part, then the right one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meeting, ids, held, state = None, [], [], None

        def left() -> Iterator[pd.DataFrame]:
            if state is not None:
                i, _, top, total, own, cross = state
                yield pd.DataFrame({"batch": meeting[0], "side": 0, "item": i, "top": top, "total": total, "own": own, "cross": cross})

        for frame in frames:
            for (*now, side), rows in frame.groupby(["batch", "left", "right", "side"], sort=False):
                if now != meeting:
                    yield from left()
                    meeting, ids, held, state = now, [], [], None
                if side == 0:
                    ids.append(rows["item"].to_numpy())
                    held.append(np.stack(rows["v"].to_list()))
                    continue
                if not held and state is None:
                    continue
                if state is None:
                    i, a = np.concatenate(ids), np.concatenate(held)
                    ids, held, state = [], [], (i, a, np.full(len(i), -np.inf), np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(i)))
                for k in range(0, len(rows), block):
                    j, b = rows["item"].to_numpy()[k : k + block], np.stack(rows["v"].iloc[k : k + block].to_list())
                    i, a, top, total, own, cross = state
                    logits = scale * (a @ b.T)
                    signed = logits + bias
                    most, own_j = logits.max(0), np.zeros(len(j))
                    if now[1] == now[2]:  # partners are in parts of one number
                        same = i[:, None] == j[None, :]
                        signed = np.where(same, -signed, signed)
                        mine = np.where(same, logits, 0.0)
                        own, own_j = own + mine.sum(1), mine.sum(0)
                    cross = cross + (np.maximum(signed, 0.0) + np.log1p(np.exp(-np.abs(signed)))).sum(1)  # binary cross-entropy of a pair that belongs together, or not
                    new = np.maximum(top, logits.max(1))
                    total = total * np.exp(top - new) + np.exp(logits - new[:, None]).sum(1)
                    yield pd.DataFrame({"batch": now[0], "side": 1, "item": j, "top": most, "total": np.exp(logits - most).sum(0), "own": own_j, "cross": 0.0})
                    state = (i, a, new, total, own, cross)
        yield from left()

    return run


def contrastive(pairs: DataFrame, scale: float = 1.0, bias: float = 0.0, block: int = 512, held: int = 16_384) -> DataFrame:
    """``(batch, n, softmax, sigmoid)``: of each batch, the mean cross-entropy of finding each item's partner, over both sides,
    and the mean binary cross-entropy of all its pairs.

    ``pairs``: ``batch, item`` (whole numbers, an item once a batch), ``a`` and ``b`` (arrays of one length). Logits are ``scale``
    times inner products; the sigmoid's also have the ``bias``. An empty table gives no row; rows without a side take no part.

    A task holds a part of about ``held`` rows of one side and meets the other side's part ``block`` rows at a time, so a row is shuffled
    and leaves sums once for each ``held`` rows of its batch. Time grows with the square of a batch: all its pairs have a logit.
    """
    rows = pairs.where("batch is not null and item is not null and a is not null and b is not null").select("batch", "item", "a", "b")
    sizes = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    parts_of = F.ceil(F.col("n") / held)
    slot = F.pmod(F.xxhash64("item"), parts_of)
    value = lambda c: F.col(c).cast("array<double>")
    dealt = rows.join(sizes, "batch").select("batch", "item", value("a").alias("a"), value("b").alias("b"), slot.cast("int").alias("slot"), F.explode(F.sequence(F.lit(0), parts_of.cast("int") - 1)).alias("other"))
    side = lambda k, left, right, v: dealt.select("batch", F.col(left).alias("left"), F.col(right).alias("right"), F.lit(k).alias("side"), "item", F.col(v).alias("v"))
    met = side(0, "slot", "other", "a").unionByName(side(1, "other", "slot", "b"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, "batch", "left", "right").sortWithinPartitions("batch", "left", "right", "side")
    parts = written(met.mapInPandas(_partial(scale, bias, block), _PART), "log-sums")
    tops = parts.groupBy("batch", "side", "item").agg(F.max("top").alias("most"))
    each = parts.join(tops, ["batch", "side", "item"]).groupBy("batch", "side", "item", "most").agg(F.sum(F.col("total") * F.exp(F.col("top") - F.col("most"))).alias("total"), F.sum("own").alias("own"), F.sum("cross").alias("cross"))
    each = each.select("batch", "side", (F.col("most") + F.log("total") - F.col("own")).alias("lost"), "cross")
    n = F.count_if(F.col("side") == 0)
    return each.groupBy("batch").agg(n.alias("n"), F.avg("lost").alias("softmax"), (F.sum("cross") / (n * n)).alias("sigmoid"))


def mask_losses(cells: DataFrame, group: str, mask: str, logit: str, target: str) -> DataFrame:
    """``(group, masks, dice, cross)``: of each group, the means over its masks of the dice loss and of the binary cross-entropy.

    ``cells`` has a row for each point of a mask: its logit and whether it belongs (0 or 1, or a share). Sums are made a mask before the
    shuffle; exponentials never overflow. Rows with a null logit or target take no part.
    """
    x, t = F.col(logit).cast("double"), F.col(target).cast("double")
    p = F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
    cross = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    sums = cells.where(x.isNotNull() & t.isNotNull()).groupBy(group, mask).agg(F.sum(p * t).alias("_both"), F.sum(p).alias("_p"), F.sum(t).alias("_t"), F.avg(cross).alias("_cross"))
    dice = 1 - (2 * F.col("_both") + 1) / (F.col("_p") + F.col("_t") + 1)
    return sums.groupBy(group).agg(F.count(F.lit(1)).alias("masks"), F.avg(dice).alias("dice"), F.avg("_cross").alias("cross"))


def class_cross(logits: Column, label: Column, ignore: int | None = None) -> Column:
    """Cross-entropy of an array of logits against its true class, counted from 0; null where the label is ignored, null or beyond the array."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    lost = top + F.log(total) - F.get(logits, label.cast("int"))
    return lost if ignore is None else F.when(label != ignore, lost)
