"""Session helpers shared by every operator: tables, the shared folder, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; read by Spark only, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and runs in this process (tests, a laptop), a temporary folder becomes the
    checkpoint folder; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="spark-stoa-")
        context.setCheckpointDir(own)
        return own
    return current.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here drop their shuffle files at their end, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for small tables of iterative jobs."""
    spark = df.sparkSession
    shared_dir(spark)
    with shuffles_dropped(spark):
        return df.select("*").checkpoint()  # a query of its own, made in here


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows, else ``df`` for Spark to shuffle."""
    counted = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return F.broadcast(df) if counted <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_skewed(rows: DataFrame, names: DataFrame, key: str, weight: str, most: int = 1000) -> DataFrame:
    """``rows`` joined with ``names`` (one row a key) on ``key``, whatever share of the rows one key has.

    ``weight`` of ``names`` says how many rows bear the key, and is dropped. Keys of more than ``1 / most`` of all
    rows, of which there can be no more than ``most``, come by broadcast; the others by shuffle. ``names`` is made once.
    """
    names = cut(names)
    total = names.agg(F.sum(weight).alias("n")).first()["n"] or 0
    heavy = F.col(weight) * most > total
    hot, cool = F.broadcast(names.where(heavy).drop(weight)), names.where(~heavy).drop(weight)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cool, key))
