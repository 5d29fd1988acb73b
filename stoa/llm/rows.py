"""Rows told apart by themselves: keys of whole rows, and a table taken by a plan of such keys, without a copy of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoa.session import free_name


def row_keys(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns, ``k1`` and ``k2``; equal rows have equal keys."""
    return [F.xxhash64(*docs.columns).alias("k1"), F.xxhash64(F.lit(1), *docs.columns).alias("k2")]


def taken_rows(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs``' rows by ``plan`` (``k1, k2, rows, copies``): those of a key, of which there are ``rows``, ``copies`` times in all.

    Equal rows can't be told apart, so one of them stands for all; they are reduced before their shuffle.
    """
    a, b, n, m, held = (free_name(docs, c) for c in ("_k1", "_k2", "_copies", "_rows", "_held"))
    keys = row_keys(docs)
    keyed = docs.withColumns({a: keys[0], b: keys[1]})
    own = plan.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("copies").cast("int").alias(n), F.col("rows").alias(m))
    met = keyed.join(own, [a, b])
    single = met.where(F.col(m) == 1).select(F.struct(*[F.col(c) for c in docs.columns]).alias(held), n)
    several = met.where(F.col(m) > 1).groupBy(a, b, n).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias(held)).select(held, n)
    each = single.unionByName(several)
    return each.select(held, F.explode(F.sequence(F.lit(1), F.col(n)))).select(f"{held}.*")
