"""Queries over scene and navigation graphs: regions hold nations hold suppliers; nations form a ring."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoa.operators import graph
from stoa.plans.registry import query
from stoa.session import table


def edges(spark, sf):
    r = table(spark, sf, "region").select(F.lit("floor").alias("src"), F.concat(F.lit("r"), "r_regionkey").alias("dst"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    return r.unionByName(n).unionByName(s)


EDGES = """e AS (SELECT 'floor' AS src, 'r' || r_regionkey AS dst FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


@query(f"WITH {EDGES} SELECT src, dst, 'contains' AS relation FROM e")
def scene_graph_contains(spark, sf):
    return edges(spark, sf).withColumn("relation", F.lit("contains"))


@query(f"WITH RECURSIVE {EDGES}, t AS (SELECT 'floor' AS node, 'floor' AS path, 0 AS depth UNION ALL SELECT dst, path || '/' || dst, depth + 1 FROM t JOIN e ON src = node) SELECT node, path, depth FROM t")
def scene_tree(spark, sf):
    return graph.tree(edges(spark, sf), "floor")


@query(f"WITH {EDGES} SELECT dst AS node, src AS other, 'contained_in' AS relation FROM e UNION ALL SELECT src, dst, 'contains' FROM e")
def inverse_relations(spark, sf):
    """Every edge from both ends, the reverse one under its inverse relation."""
    return graph.with_inverse(edges(spark, sf).withColumn("relation", F.lit("contains")), {"contains": "contained_in"})


@query(f"WITH {EDGES} SELECT src AS node, count(*) AS children FROM e GROUP BY src")
def children_count(spark, sf):
    return edges(spark, sf).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("children"))


NAV = "nav AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 24) % 25 FROM nation UNION SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation WHERE n_nationkey % 5 = 0)"


def nav(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"))
    step = lambda d: n.select("src", ((F.col("src") + d) % 25).alias("dst"))
    return step(1).unionByName(step(24)).unionByName(step(7).where("src % 5 = 0")).distinct()


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS src, unnest([p_partkey * 2, p_partkey * 2 + 1, p_partkey - 7]) AS dst FROM part), way AS (SELECT src, dst FROM w JOIN part ON p_partkey = dst),
b AS (SELECT 3::BIGINT AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM b JOIN way ON src = node WHERE hops < 24) SELECT node, min(hops) AS hops FROM b GROUP BY node""")
def bfs_distances(spark, sf):
    """Hops from one place over a graph as large as ``part``: two ways ahead and one back from each place."""
    k = F.col("p_partkey")
    ways = table(spark, sf, "part").select(k.alias("src"), F.explode(F.array(k * 2, k * 2 + 1, k - 7)).alias("dst"))
    places = table(spark, sf, "part").select(k.alias("dst")).hint("merge")  # one column looks small to Spark however many rows it has
    return graph.distances(ways.join(places, "dst", "left_semi").select("src", "dst"), 3)


@query(f"WITH {NAV}, p(plan_id, step, node) AS (VALUES (1,0,0),(1,1,1),(1,2,2),(2,0,5),(2,1,12),(2,2,14),(3,0,9),(3,1,99)), s AS (SELECT *, lag(node) OVER (PARTITION BY plan_id ORDER BY step) AS before FROM p) SELECT plan_id, step, node, before FROM s WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nav WHERE src = before AND dst = node)")
def plan_broken_steps(spark, sf):
    """Steps of a plan that follow no edge."""
    steps = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 5), (2, 1, 12), (2, 2, 14), (3, 0, 9), (3, 1, 99)], "plan_id int, step int, node int")
    return graph.broken_steps(steps, nav(spark, sf))
