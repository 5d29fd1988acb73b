"""Instance masks against ground truth: intersections, greedy matching at several overlaps, average precision."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stoa.session import written


def intersections(masks: DataFrame, truth: DataFrame) -> DataFrame:
    """``(scene, mask_id, instance, class, points, both, size)`` of masks and instances of one class that share points.

    ``masks``: ``scene, mask_id, class, point_id``; ``truth``: ``scene, point_id, class, instance`` (null class: ignored).
    """
    size = truth.where("class is not null").groupBy("scene", "class", "instance").agg(F.count(F.lit(1)).alias("size"))
    points = masks.groupBy("scene", "mask_id", "class").agg(F.count(F.lit(1)).alias("points"))
    met = masks.join(truth.where("class is not null").select("scene", "point_id", "class", "instance"), ["scene", "point_id", "class"])
    both = met.groupBy("scene", "class", "mask_id", "instance").agg(F.count(F.lit(1)).alias("both"))
    return both.join(size, ["scene", "class", "instance"]).join(points, ["scene", "class", "mask_id"])


def match(pairs: pd.DataFrame, overlaps: list[float]) -> Iterator[tuple[float, float, int, int]]:
    """``(overlap, score, hit, missed)`` of one scene's class: instances take masks in order of id, each mask once.

    ``pairs``: ``instance, mask_id, score, share`` with rows of null mask for instances and of null instance for
    masks without partner. A second mask of an instance is a false hit at the lower of both scores; an instance
    without any is missed. Masks that overlap no instance enough are false hits, unless ignored points make up
    more than the overlap of them (``ignored``).
    """
    for limit in overlaps:
        taken: set = set()
        for _, own in pairs[pairs["instance"].notna()].groupby("instance"):
            best = None
            for r in own[own["mask_id"].notna()].sort_values("mask_id").itertuples():
                if r.mask_id in taken or not r.share > limit:
                    continue
                if best is None:
                    best = r.score
                    taken.add(r.mask_id)
                else:
                    yield limit, min(best, r.score), 0, 0
                    best = max(best, r.score)
            if best is None:
                yield limit, 0.0, 0, 1
            else:
                yield limit, best, 1, 0
        for _, own in pairs[pairs["mask_id"].notna()].groupby("mask_id"):
            if not (own["share"] > limit).any() and own["ignored"].iloc[0] <= limit:
                yield limit, float(own["score"].iloc[0]), 0, 0


def matches(masks: DataFrame, scores: DataFrame, truth: DataFrame, overlaps: list[float], least: int) -> DataFrame:
    """``(class, overlap, score, hit, missed)`` over all scenes; masks and instances of under ``least`` points don't count.

    Points are counted by Spark; what a group gets is a row for each mask and instance of one class in one scene.
    """
    sized = masks.groupBy("scene", "mask_id", "class").agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= least)
    void = masks.join(truth.where("class is null").select("scene", "point_id"), ["scene", "point_id"]).groupBy("scene", "mask_id").agg(F.count(F.lit(1)).alias("void"))
    pairs = intersections(masks, truth).join(sized.select("scene", "mask_id"), ["scene", "mask_id"])
    small = pairs.where(F.col("size") < least).groupBy("scene", "mask_id").agg(F.sum("both").alias("tiny"))
    told = sized.join(void, ["scene", "mask_id"], "left").join(small, ["scene", "mask_id"], "left").join(scores, ["scene", "mask_id"])
    told = told.select("scene", "class", "mask_id", "score", ((F.coalesce("void", F.lit(0)) + F.coalesce("tiny", F.lit(0))) / F.col("points")).alias("ignored"))
    share = pairs.select("scene", "class", "mask_id", F.when(F.col("size") >= least, F.col("instance")).alias("instance"), (F.col("both") / (F.col("size") + F.col("points") - F.col("both"))).alias("share"))
    found = told.join(share, ["scene", "class", "mask_id"], "left")
    all_ = truth.where("class is not null").groupBy("scene", "class", "instance").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    none = F.lit(None)
    alone = all_.select("scene", "class", none.cast("long").alias("mask_id"), none.cast("double").alias("score"), none.cast("double").alias("ignored"), F.col("instance").cast("long").alias("instance"), none.cast("double").alias("share"))
    rows = found.select("scene", "class", F.col("mask_id").cast("long").alias("mask_id"), "score", "ignored", F.col("instance").cast("long").alias("instance"), "share").unionByName(alone)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        name = group["class"].iloc[0]
        return pd.DataFrame([(name, *m) for m in match(group, overlaps)], columns=["class", "overlap", "score", "hit", "missed"])

    return rows.groupBy("scene", "class").applyInPandas(one, "class long, overlap double, score double, hit int, missed int")


def average_precision(found: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, ap)`` from ``keys, score, hit, missed``: the area below the envelope of precision over recall.

    A group with instances but no mask has 0. Equal scores keep their hits first.
    """
    rows = found.where("missed = 0")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("hit"))
    own = Window.partitionBy(*keys)
    lost = found.groupBy(*keys).agg(F.sum("missed").alias("lost"), F.sum("hit").alias("hits"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    c = rows.select(*keys, "hit", F.sum("hit").over(so_far).alias("tp"), F.row_number().over(order).alias("n"))
    ahead = own.orderBy("n").rowsBetween(0, Window.unboundedFollowing)
    c = c.withColumn("env", F.max(F.col("tp") / F.col("n")).over(ahead))
    area = c.where("hit = 1").groupBy(*keys).agg(F.sum("env").alias("area"))
    return lost.where("hits + lost > 0").join(area, keys, "left").select(*keys, (F.coalesce("area", F.lit(0.0)) / (F.col("hits") + F.col("lost"))).alias("ap"))


def ranked_precision(rows: DataFrame, score: str, key: str, hit: str) -> DataFrame:
    """``(hit, tp, n, envelope)`` of rows by descending score, ties by key: hits and rows so far, and the best precision from there on.

    Rows are dealt by ranges of the order; what a range needs of the others is one row each.
    """
    order = [F.desc(score), F.col(key)]
    dealt = written(rows.select(score, key, hit).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranking")
    ranges = Window.orderBy("_range")  # a row a range
    before = lambda c: F.coalesce(F.sum(c).over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(hit).alias("_h")).select("_range", before("_n").alias("_n"), before("_h").alias("_h"))
    own = Window.partitionBy("_range").orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(sums), "_range").withColumns({"tp": F.col("_h") + F.sum(hit).over(so_far), "n": F.col("_n") + F.row_number().over(own)})
    placed = placed.withColumn("p", F.col("tp") / F.col("n"))
    tops = placed.groupBy("_range").agg(F.max("p").alias("p")).select("_range", F.max("p").over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    local = F.max("p").over(own.rowsBetween(0, Window.unboundedFollowing))
    return placed.join(F.broadcast(tops), "_range").select(hit, "tp", "n", F.greatest(local, "_later").alias("envelope"))
