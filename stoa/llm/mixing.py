"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Each document draws an exponential key ``-ln(u) / w``, ``u`` from a hash of the row and ``w`` its quality
weight; within a source, ascending keys are a weighted sample without replacement. A source takes its complete
epochs first, then documents in order of key while their sizes fit what is left of its target.

A source may hold a third of all rows, so its order is never built in one task: keys fall into buckets by their
exponent and leading mantissa bits (about 0.2 % of a source each, whatever the weights), sizes are summed by
bucket, and only the bucket in which the target ends is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoa.llm.rows import row_keys, taken_rows
from stoa.session import broadcast_if_small, written

WORD = r"[^\x20\x09-\x0D]+"
PER_OCTAVE = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_share(text: Column) -> Column:
    """A quality weight from 0.05 to 1: less for texts full of markup and symbols; null and empty texts have 1."""
    symbols = F.length(text) - F.length(F.translate(text, "#$%&*|{}<>=\\^~@_[]", ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 4.0 * symbols / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code-point order, null last, have the ``weights`` in turn and share ``share`` of all sizes; none
    gets over ``cap`` times its size, the excess going to the others by weight. With sources in order of size
    over weight, those before some place are capped and the rest get ``level`` for each unit of weight. There is
    one row a source, and that table alone is put in order.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    table = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns(
        {
            "_left": share * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "_weights": F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)),
        }
    )
    level = F.col("_left") / F.col("_weights")
    open_ = cap * F.col("source_size") > level * F.col("_weight")
    table = table.withColumn("_level", F.max(F.when(open_, level)).over(everything))
    target = F.least(cap * F.col("source_size"), F.coalesce(F.col("_level") * F.col("_weight"), cap * F.col("source_size")))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def _drawn(docs: DataFrame, carried: list[Column], doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, seed: int = 7,
           weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(doc_id, size, source_size, target, copies)`` and the ``carried`` columns: how often the mix takes each row."""
    names = [docs.select(c).columns[0] for c in carried]
    weight = F.greatest(quality if quality is not None else plain_share(F.col(text)), F.lit(1e-6))
    draw = (F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    drawn = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), (-F.log(draw) / weight).alias("key"), *carried)
    drawn = written(drawn.withColumn("bucket", F.floor(F.log2("key") * PER_OCTAVE)), "mixing")
    buckets = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    targets = targets.withColumns(
        {"epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")}
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("before", F.coalesce(F.sum("size").over(sums), F.lit(0))).select(F.col("source").alias("s"), "bucket", "size", "before")
    ends = placed.join(targets, F.col("s").eqNullSafe(F.col("source"))).where("before < rest and before + size >= rest")
    ends = ends.groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("end"))
    plan = targets.join(ends.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")), "left")
    plan = broadcast_if_small(
        written(plan.select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before")), "mixing-plan")
    )
    rows = drawn.join(plan, F.col("s").eqNullSafe(F.col("source")))
    inside = F.col("bucket") == F.col("end_bucket")
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where(inside).withColumn("sum", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("more", (F.col("sum") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("sum")
    others = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("more", F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(False)).cast("long"))
    return others.unionByName(last).select("doc_id", "size", "source_size", "target", (F.col("epochs") + F.col("more")).alias("copies"), *names)


def mixed(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)``: how often the mix takes each row, one row for each.

    Options are ``text, source, quality, seed, weights, share, cap``; ``quality`` is a column of weights, by default
    the share of the text that isn't symbols. A source's taken words differ from its target by at most half of the
    one document in which the target ends. Null texts have no words, a null source is a source, null ids are ids.
    Equal rows draw equal keys and are interchangeable; reruns agree. An empty table gives no row.
    """
    rows = _drawn(docs, [], doc_id, **options)
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated_by_mix(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (a row whose mix is zero goes); rows are drawn one by one,
    whatever ids they share. Columns stay as they are."""
    rows = _drawn(docs, row_keys(docs), doc_id, **options)
    plan = rows.groupBy("k1", "k2").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    return taken_rows(docs, plan)
