"""Label evidence: weighted votes, decisions, histograms and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vote_weight(score: Column, centre: Column) -> Column:
    """Score clipped to [0, 1] times centre weight clipped to [0.01, 1]."""
    return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))) * F.greatest(F.lit(0.01), F.least(centre, F.lit(1.0)))


def vote_sums(votes: DataFrame, point: str, label: str, weight: Column) -> DataFrame:
    """Summed weight of each point's labels; partial sums are made before the shuffle."""
    return votes.groupBy(F.col(point).alias("point_id"), F.col(label).alias("label")).agg(F.sum(weight).alias("w"))


def best_label(sums: DataFrame, digits: int = 9) -> DataFrame:
    """Each point's label of the largest sum, ties (to ``digits`` places) to the lowest label: one aggregate."""
    best = F.min_by(F.struct("label", "w"), F.struct((-F.round("w", digits)).alias("w"), F.col("label").alias("l")))
    return sums.groupBy("point_id").agg(best.alias("b")).select("point_id", "b.label", "b.w")


def reliability_threshold(samples: DataFrame, group: str, value: Column, fraction: float, bins: int = 256) -> DataFrame:
    """Per group, the highest bin from which at least ``ceil(n * fraction)`` values lie at or above it, over ``bins - 1``."""
    binned = samples.groupBy(F.col(group).alias("instance"), F.least(F.lit(bins - 1), F.floor(value * (bins - 1))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("instance")
    above = F.sum("n").over(own.orderBy(F.desc("bin")))
    target = F.ceil(F.sum("n").over(own) * fraction)
    return binned.withColumns({"above": above, "target": target}).where("above >= target").groupBy("instance").agg((F.max("bin") / (bins - 1)).alias("threshold"))


def ranked(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in order, with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(name) <= k)
