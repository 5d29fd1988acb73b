"""Relations of object boxes: plausibility of a label's shape, gaps, support and room votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoa.session import written


def box_gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Distance of two boxes of the plane, zero where they overlap. Keys: x0, x1, y0, y1."""
    dx = F.greatest(a["x0"] - b["x1"], b["x0"] - a["x1"], F.lit(0.0))
    dy = F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def box_pairs(boxes: DataFrame, key: str, limit: float) -> DataFrame:
    """``(a_*, b_*)`` of boxes whose plane gap is at most ``limit``, each pair once with a's key smaller.

    Boxes go to the cells that they cover with a margin; two boxes are compared in the first cell that both cover,
    so a pair is made once and only neighbours meet. Cells are a few limits wide, and not less than nine in ten
    of the boxes, so most boxes have four cells at most. Both sides are shuffled: what a box computes or carries doesn't
    show in the size of its table, from which Spark would take it for small enough to go through the driver.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    usual = boxes.agg(F.percentile_approx(side, 0.9).alias("w")).first()["w"] or 0.0
    width = max(4 * limit, float(usual))

    def cells(axis: str, margin: float) -> Column:
        return F.sequence(F.floor((F.col(f"{axis}0") - margin) / width), F.floor((F.col(f"{axis}1") + margin) / width))

    def spread(side: str, margin: float) -> DataFrame:
        laid = boxes.withColumns({"_cell_x": F.explode(cells("x", margin))}).withColumn("_cell_y", F.explode(cells("y", margin)))
        return laid.select("_cell_x", "_cell_y", *[F.col(c).alias(f"{side}_{c}") for c in boxes.columns])

    a, b = ({k: F.col(f"{s}_{k}") for k in ("x0", "x1", "y0", "y1")} for s in "ab")
    met = spread("a", limit).join(spread("b", 0.0).hint("merge"), ["_cell_x", "_cell_y"]).where((F.col(f"a_{key}") < F.col(f"b_{key}")) & (box_gap(a, b) <= limit))
    first = (F.col("_cell_x") == F.greatest(F.floor((a["x0"] - limit) / width), F.floor(b["x0"] / width))) & (F.col("_cell_y") == F.greatest(F.floor((a["y0"] - limit) / width), F.floor(b["y0"] / width)))
    return met.where(first).drop("_cell_x", "_cell_y").withColumn("gap", box_gap(a, b))


def _block_pairs(boxes: DataFrame, key: str, limit: float, most: int) -> DataFrame:
    """``(a, a_ids, b, b_ids, gap)``: equal boxes in blocks of about ``most`` keys (sorted), each pair of near blocks once, a block with itself too.

    A block is named by its least key. So boxes are compared once for all of their equals.
    """
    place = ["x0", "x1", "y0", "y1"]
    own = boxes.where(" and ".join(f"{c} is not null" for c in [key, *place])).select(F.col(key).alias("_id"), *place)
    slot = F.pmod(F.xxhash64("_id"), F.ceil(F.col("n") / most)).alias("_slot")
    dealt = own.join(own.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), place).select("_id", *place, slot)
    blocks = dealt.groupBy(*place, "_slot").agg(F.sort_array(F.collect_list("_id")).alias("ids"))
    blocks = written(blocks.select(F.get("ids", F.lit(0)).alias("block"), "ids", *place), "equal-boxes")
    met = box_pairs(blocks, "block", limit).select(F.col("a_block").alias("a"), "a_ids", F.col("b_block").alias("b"), "b_ids", "gap")
    at = {c: F.col(c) for c in place}
    own = blocks.select(F.col("block").alias("a"), F.col("ids").alias("a_ids"), F.col("block").alias("b"), F.col("ids").alias("b_ids"), box_gap(at, at).alias("gap"))
    return met.unionByName(own.where(F.col("gap") <= limit))


def near_pairs(boxes: DataFrame, key: str, limit: float, most: int = 1024) -> DataFrame:
    """``(a, b, gap)`` of boxes whose plane gap is at most ``limit``, each pair once with a < b, as ``box_pairs`` finds them.

    Equal boxes are compared once; what is left of the work for them is to write their pairs.
    """
    pairs = _block_pairs(boxes, key, limit, most)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(n, "a", "b")  # few bytes make many rows, so tasks aren't told by bytes
    i = dealt.select(F.col("a") == F.col("b"), "b_ids", "gap", F.explode("a_ids").alias("i")).toDF("own", "b_ids", "gap", "i")
    both = i.select("own", "gap", "i", F.explode("b_ids").alias("j")).where(~F.col("own") | (F.col("i") < F.col("j")))
    return both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "gap")


def nearest_after(boxes: DataFrame, key: str, limit: float, cap: int, digits: int = 9, most: int = 1024) -> DataFrame:
    """``(src, dst, rank)``: of each box (a whole number as ``key``) the ``cap`` nearest of larger key within ``limit``, ties (gaps to ``digits``) to the smaller key.

    Of each block of equal boxes only those blocks stay in play to which fewer than ``cap`` larger keys are nearer, whichever of its
    boxes asks; of such a block each box takes the first ``cap`` larger keys.
    """
    pairs = _block_pairs(boxes, key, limit, most).withColumn("gap", F.round("gap", digits))
    back = pairs.where("a <> b").select(F.col("b").alias("a"), F.col("b_ids").alias("a_ids"), F.col("a").alias("b"), F.col("a_ids").alias("b_ids"), "gap")
    top = F.element_at("a_ids", -1)
    asked = pairs.unionByName(back).where(F.element_at("b_ids", -1) > F.get("a_ids", F.lit(0)))
    asked = asked.withColumn("k", F.size(F.filter("b_ids", lambda x: x > top)))
    nearer = F.sum("k").over(Window.partitionBy("a").orderBy("gap")) - F.sum("k").over(Window.partitionBy("a", "gap"))
    kept = asked.withColumn("nearer", nearer).where(F.col("nearer") < cap).select("a", "a_ids", "b_ids", "gap")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def first(src: np.ndarray, held: list) -> pd.DataFrame:
        dst, gap = np.concatenate([ids for ids, _ in held]), np.concatenate([np.full(len(ids), g) for ids, g in held])
        order = np.lexsort((dst, gap))
        dst, gap, found = dst[order], gap[order], []
        for k in range(0, len(src), 256):
            later = dst[None] > src[k : k + 256, None]
            i, j = np.nonzero(later & (np.cumsum(later, 1) <= cap))
            found.append((src[k + i], gap[j], dst[j]))
        return pd.DataFrame(dict(zip(("src", "gap", "dst"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            last, src, held, size, out = None, None, [], 0, []
            for a, a_ids, b_ids, gap in frame.itertuples(index=False):
                if held and (a != last or size >= 4096):
                    out.append(first(src, held))
                    held, size = [], 0
                if a != last:
                    last, src = a, np.asarray(a_ids)
                held.append((np.asarray(b_ids), gap))
                size += len(b_ids)
            out += [first(src, held)] if held else []
            if out:
                yield pd.concat(out)

    kind = boxes.schema[key].dataType.simpleString()
    found = kept.repartition(n, "a").sortWithinPartitions("a", "gap").mapInPandas(run, f"src {kind}, gap double, dst {kind}")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("gap", "dst")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= cap).select("src", "dst", "rank")


def majority(rows: DataFrame, group: str, choice: str) -> DataFrame:
    """Each group's most frequent choice, ties to the smallest; nulls don't vote."""
    n = rows.where(F.col(choice).isNotNull()).groupBy(group, choice).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(group).agg(F.min_by(choice, F.struct(-F.col("n"), F.col(choice))).alias(choice))
