"""Queries of point colours and batches: parts are points of scenes (brands), sizes and prices their channels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.plans.registry import query
from stoa.session import table


@query("SELECT p_partkey AS point_id, round((p_size * 5) / 127.5 - 1, 9) AS r FROM part")
def normalised_colour(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), F.round(F.col("p_size") * 5 / 127.5 - 1, 9).alias("r"))


@query("""WITH s AS (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand)
SELECT p_partkey AS point_id, round(CASE WHEN hi > lo THEN 0.5*p_size + 0.5*(p_size-lo)*255.0/(hi-lo) ELSE p_size END, 6) AS r FROM part JOIN s USING (p_brand)""")
def auto_contrast(spark, sf):
    """Each scene's channel stretched to 0..255 and blended in equal parts with what it was; a flat channel stays.

    Extremes are aggregated by scene before the join, so a large scene is never one task's group."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("c"))
    ends = part.groupBy("p_brand").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    stretched = 0.5 * F.col("c") + 0.5 * (F.col("c") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo"))
    return part.join(ends, "p_brand").select(F.col("p_partkey").alias("point_id"), F.round(F.when(F.col("hi") > F.col("lo"), stretched).otherwise(F.col("c")), 6).alias("r"))


@query("WITH n AS (SELECT label AS batch, count(*) AS n FROM embeddings GROUP BY label) SELECT batch, n, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS end_offset FROM n")
def batch_offsets(spark, sf):
    """Rows of each batch and where it ends; the running sum goes over batches, one row each."""
    n = table(spark, sf, "embeddings").groupBy(F.col("label").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("end_offset", F.sum("n").over(Window.orderBy("batch")))
