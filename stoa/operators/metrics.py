"""Metrics as state that merges: what a run adds is a table of counts, and metrics come from the sum of any runs' tables.

State is ``(kind, class, other, overlap, score, hits, falses, missed)``, one row a key: confusion cells (``kind`` 0: true class,
predicted class, points in ``hits``) and matched masks (``kind`` 1: class, overlap, score, and how many masks of that score were
right or wrong, and instances were missed). Sums are whole numbers, so any order and split of the runs gives the same state.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stoa.session import written

KEYS = ["kind", "class", "other", "overlap", "score"]
COUNTS = ["hits", "falses", "missed"]
STATE = "kind int, class long, other long, overlap double, score double, hits long, falses long, missed long"


def confusion_state(points: DataFrame) -> DataFrame:
    """State of labelled points (``gt, pred``); points without a true class take no part, those without a prediction count as such."""
    n = points.where("gt is not null").groupBy(F.col("gt").cast("long").alias("class"), F.col("pred").cast("long").alias("other")).agg(F.count(F.lit(1)).alias("hits"))
    none = F.lit(None).cast("double")
    return n.select(F.lit(0).alias("kind"), "class", "other", none.alias("overlap"), none.alias("score"), "hits", F.lit(0).cast("long").alias("falses"), F.lit(0).cast("long").alias("missed"))


def matching_state(found: DataFrame) -> DataFrame:
    """State of matched masks (``class, overlap, score, hit, missed``, as the matching gives them): equal scores are one row."""
    score = F.when(F.col("missed") == 0, F.col("score"))
    n = found.groupBy(F.col("class").cast("long").alias("class"), "overlap", score.alias("score")).agg(F.count_if(F.expr("hit = 1")).alias("hits"), F.count_if(F.expr("hit = 0 and missed = 0")).alias("falses"), F.count_if(F.expr("missed = 1")).alias("missed"))
    return n.select(F.lit(1).alias("kind"), "class", F.lit(None).cast("long").alias("other"), "overlap", "score", *COUNTS)


def merged(*states: DataFrame) -> DataFrame:
    """One state of several: counts of equal keys are added."""
    both = states[0].select(*KEYS, *COUNTS)
    for s in states[1:]:
        both = both.unionByName(s.select(*KEYS, *COUNTS))
    return both.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])


def saved(state: DataFrame, path: str, run: str) -> None:
    """Keeps a run's state below ``path``. A run that is saved again, after a failure say, replaces what it saved before."""
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"a run's name has letters, digits, _, . and - only: {run!r}")
    merged(state).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def continued(spark: SparkSession, path: str) -> DataFrame:
    """The state of all runs below ``path``."""
    return merged(spark.read.schema(STATE).option("recursiveFileLookup", True).parquet(path))


def class_scores(state: DataFrame) -> DataFrame:
    """``(class, iou, accuracy)`` of each class that occurs as true or predicted."""
    c = state.where("kind = 0")
    side = lambda k, mine: F.struct(F.col(k).alias("class"), F.lit(int(mine)).alias("g"), F.lit(int(not mine)).alias("q"))
    rows = c.select(F.explode(F.array(side("class", True), side("other", False))).alias("s"), F.col("hits").alias("n"), (F.col("class") == F.col("other")).alias("same")).where("s.class is not null")
    g, q = F.sum(F.col("s.g") * F.col("n")), F.sum(F.col("s.q") * F.col("n"))
    tp = F.coalesce(F.sum(F.when(F.col("same"), F.col("s.g") * F.col("n"))), F.lit(0))
    sums = rows.groupBy("s.class").agg(g.alias("g"), q.alias("q"), tp.alias("tp"))
    return sums.select("class", (F.col("tp") / (F.col("g") + F.col("q") - F.col("tp"))).alias("iou"), F.when(F.col("g") > 0, F.col("tp") / F.col("g")).otherwise(0.0).alias("accuracy"))


def average_precisions(state: DataFrame) -> DataFrame:
    """``(class, overlap, ap)``: the area below the envelope of precision over recall, equal scores with their hits first.

    The ranking is cut into ranges of (class, overlap, falling score), however large one class is; ranges tell each other a row a
    class and overlap that they hold. A class with instances and without masks has 0; without instances it has no row.
    """
    keys = ["class", "overlap"]
    rows = state.where("kind = 1")
    totals = rows.groupBy(*keys).agg(F.sum(F.col("hits") + F.col("missed")).alias("instances")).where("instances > 0")
    ranked = rows.where("score is not null").select(*keys, "score", "hits", "falses")
    dealt = written(ranked.repartitionByRange(*keys, F.desc("score")).withColumn("_range", F.spark_partition_id()), "ranking")
    ranges = Window.partitionBy(*keys).orderBy("_range")  # a row a range and key
    before = lambda c: F.coalesce(F.sum(c).over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(c)
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("hits").alias("_h"), F.sum(F.col("hits") + F.col("falses")).alias("_n"))
    own = Window.partitionBy("_range", *keys).orderBy(F.desc("score"))
    so_far = lambda c: F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.join(sums.select(*keys, "_range", before("_h"), before("_n")), [*keys, "_range"])
    hits = F.col("_h") + so_far("hits")
    # precision is highest at a score's last hit, and later scores may do better
    placed = placed.select(*keys, "_range", "score", "hits", (hits / (F.col("_n") + so_far(F.col("hits") + F.col("falses")) - F.col("falses"))).alias("p"))
    tops = placed.where("hits > 0").groupBy(*keys, "_range").agg(F.max("p").alias("top"))
    seen = dealt.select(*keys, "_range").distinct().join(tops, [*keys, "_range"], "left")
    later = seen.select(*keys, "_range", F.max("top").over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    gained = placed.where("hits > 0").join(later, [*keys, "_range"])
    envelope = F.greatest(F.max("p").over(own.rowsBetween(0, Window.unboundedFollowing)), "_later")
    area = gained.withColumn("e", envelope).groupBy(*keys).agg(F.sum(F.col("e") * F.col("hits")).alias("area"))
    return totals.join(area, keys, "left").select(*keys, (F.coalesce("area", F.lit(0.0)) / F.col("instances")).alias("ap"))
