"""Exact order statistics of large groups: histograms that narrow down to the value, no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stoa.session import cut

BINS = 2048


def order_statistics(rows: DataFrame, group: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """``(group, rank, v)``: of each group's non-null, finite values in ascending order, those at the asked ranks from 0.

    ``ranks``: ``group, rank``. Each pass counts values by ``BINS`` bins of the interval that still holds the rank
    and goes on with the bin that holds it, until that bin has one value: some passes, whatever the rows.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    spans = rows.groupBy(*group).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    left = cut(ranks.join(spans, group).withColumn("below", F.lit(0).cast("long")))
    done = left.where("lo = hi").select(*group, "rank", F.col("lo").alias("v"))
    left = left.where("lo < hi")
    while not left.isEmpty():
        place = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        met = rows.join(left, group).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        bins = met.groupBy(*group, "rank", "below", place.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        own = Window.partitionBy(*group, "rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
        bins = bins.withColumn("_at", F.col("below") + F.coalesce(F.sum("_n").over(own), F.lit(0)))
        left = cut(bins.where((F.col("_at") <= F.col("rank")) & (F.col("rank") < F.col("_at") + F.col("_n"))).select(*group, "rank", "lo", "hi", F.col("_at").alias("below")))
        done = done.unionByName(left.where("lo = hi").select(*group, "rank", F.col("lo").alias("v")))
        left = left.where("lo < hi")
    return done


def quantiles(rows: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """``(group, share, v)``: exact quantiles, linear between the two nearest order statistics."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    at = n.select(*group, "_n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    at = at.withColumn("_place", F.round(F.col("share") * (F.col("_n") - 1), 9)).withColumn("_low", F.floor("_place"))
    ranks = at.select(*group, F.explode(F.array(F.col("_low"), F.ceil("_place"))).alias("rank")).distinct()
    stats = cut(order_statistics(rows, group, value, ranks))
    side = lambda rank, name: stats.select(*group, F.col("rank").alias(rank), F.col("v").alias(name))
    both = at.withColumn("_high", F.ceil("_place")).join(side("_low", "_a"), [*group, "_low"]).join(side("_high", "_b"), [*group, "_high"])
    return both.select(*group, "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.col("_low"))).alias("v"))
