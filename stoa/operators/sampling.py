"""Samples that reruns and other engines repeat: rows in order of a hash of their keys and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoa.session import written


def draw(keys: list[str], seed: int) -> Column:
    """The hash that rows are drawn by."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hashed_top(rows: DataFrame, group: list[str], keys: list[str], seed: int, n: int | Column, more: list[str] | None = None) -> DataFrame:
    """Of each group the ``n`` rows that come first in the order of the draw, ties by the keys: an exact sample."""
    order = Window.partitionBy(*group).orderBy(draw(keys, seed), *keys, *(more or []))
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def share(keys: list[str], seed: int) -> Column:
    """A number from 0 to 1 of each row, for samples of a share."""
    return F.conv(F.substring(draw(keys, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def dense_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``(value, name)``: each distinct value's place from 0 in ascending order, in parallel.

    Values are dealt by range and numbered within their range; one row a range says how many came before.
    """
    ranged = rows.select(value).distinct().repartitionByRange(F.col(value))
    dealt = written(ranged.withColumn("_range", F.spark_partition_id()), "ranks")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(value)) - 1
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))
    return dealt.join(starts, "_range").select(value, (F.col("_before") + own).cast("long").alias(name))
