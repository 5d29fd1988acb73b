"""Queries over object boxes: parts are boxes of the plane, suppliers rooms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.operators import relations
from stoa.plans.registry import query
from stoa.session import table

BOXES = "bx AS (SELECT p_partkey AS id, (p_partkey * 37 % 1000) / 10.0::DOUBLE AS x0, (p_partkey * 37 % 1000) / 10.0::DOUBLE + p_size / 50.0::DOUBLE AS x1, (p_partkey * 91 % 1000) / 10.0::DOUBLE AS y0, (p_partkey * 91 % 1000) / 10.0::DOUBLE + 0.5::DOUBLE AS y1, (p_partkey % 7) / 2.0::DOUBLE AS z0, (p_partkey % 7) / 2.0::DOUBLE + 0.5::DOUBLE AS z1 FROM part)"
GAP = "sqrt(pow(greatest(a.x0-b.x1, b.x0-a.x1, 0),2) + pow(greatest(a.y0-b.y1, b.y0-a.y1, 0),2))"


def boxes(spark, sf):
    k = F.col("p_partkey")
    x0, y0, z0 = (k * 37 % 1000) / 10.0, (k * 91 % 1000) / 10.0, (k % 7) / 2.0
    return table(spark, sf, "part").select(k.alias("id"), x0.alias("x0"), (x0 + F.col("p_size") / 50.0).alias("x1"), y0.alias("y0"), (y0 + 0.5).alias("y1"), z0.alias("z0"), (z0 + 0.5).alias("z1"))


@query(f"WITH {BOXES} SELECT a.id AS a, b.id AS b, round({GAP},6) AS gap FROM bx a JOIN bx b ON a.id < b.id AND {GAP} <= 1.0")
def near_boxes(spark, sf):
    return relations.near_pairs(boxes(spark, sf), "id", 1.0).select("a", "b", F.round("gap", 6).alias("gap"))


OVER = "greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0)"


@query(f"WITH {BOXES} SELECT a.id AS above, b.id AS below FROM bx a JOIN bx b ON a.id <> b.id AND {OVER} > 0.2 * least((a.x1-a.x0)*(a.y1-a.y0), (b.x1-b.x0)*(b.y1-b.y0)) AND abs(a.z0 - b.z1) <= 0.15")
def support_pairs(spark, sf):
    """Objects that rest on another: footprints overlap and the bottom meets the other's top; both directions."""
    p = relations.box_pairs(boxes(spark, sf), "id", 0.01)
    c = F.col
    wide = F.greatest(F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"), F.lit(0.0)) * F.greatest(F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"), F.lit(0.0))
    small = F.least((c("a_x1") - c("a_x0")) * (c("a_y1") - c("a_y0")), (c("b_x1") - c("b_x0")) * (c("b_y1") - c("b_y0")))
    p = p.where(wide > 0.2 * small)
    on = lambda a, b: p.where(F.abs(c(f"{a}_z0") - c(f"{b}_z1")) <= 0.15).select(c(f"{a}_id").alias("above"), c(f"{b}_id").alias("below"))
    return on("a", "b").unionByName(on("b", "a"))


@query(f"""WITH {BOXES}, p AS (SELECT a.id AS src, b.id AS dst, {GAP} AS gap FROM bx a JOIN bx b ON a.id < b.id AND {GAP} <= 2.0),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(gap,9), dst) AS rank FROM p) SELECT src, dst, rank FROM r WHERE rank <= 3""")
def capped_next_to(spark, sf):
    """Of each source, the three nearest: the cap is the relation's definition."""
    return relations.nearest_after(boxes(spark, sf), "id", 2.0, 3)


@query("""WITH n AS (SELECT l_partkey AS instance_id, CASE WHEN l_suppkey % 6 > 0 THEN l_suppkey % 6 END AS room, count(*) n FROM lineitem GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY n DESC, room) rn FROM n WHERE room IS NOT NULL)
SELECT p_partkey AS instance_id, coalesce('room_' || room, 'floor') AS room FROM part LEFT JOIN r ON instance_id = p_partkey AND rn = 1""")
def room_by_majority(spark, sf):
    """Each instance's room by its points' votes; without a vote it is the floor."""
    votes = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("instance_id"), F.when(F.col("l_suppkey") % 6 > 0, F.col("l_suppkey") % 6).alias("room"))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"))
    return items.join(relations.majority(votes, "instance_id", "room"), "instance_id", "left").select("instance_id", F.coalesce(F.concat(F.lit("room_"), F.col("room").cast("string")), F.lit("floor")).alias("room"))


@query("SELECT l_partkey AS point_id, max(l_suppkey) AS room FROM lineitem GROUP BY 1")
def last_room_wins(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("point_id")).agg(F.max("l_suppkey").alias("room"))


@query("""WITH area AS (SELECT l_suppkey AS room, count(*) a FROM lineitem GROUP BY 1), rk AS (SELECT room, row_number() OVER (ORDER BY a DESC, room) r FROM area),
c AS (SELECT l_partkey AS point_id, min(r) r FROM lineitem JOIN rk ON room = l_suppkey GROUP BY 1) SELECT point_id, room FROM c JOIN rk USING (r)""")
def claimed_points(spark, sf):
    """Rooms claim points in order of size; each point goes to the first of its rooms. Ranks are one row a room."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("point_id"), F.col("l_suppkey").alias("room"))
    area = li.groupBy("room").agg(F.count(F.lit(1)).alias("a"))
    ranked = area.select("room", F.row_number().over(Window.orderBy(F.desc("a"), "room")).alias("r"))
    return li.join(ranked, "room").groupBy("point_id").agg(F.min_by("room", "r").alias("room"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 40 AND p_type LIKE '%A%' THEN printf('height %.2f m too large', p_size/20.0) WHEN p_retailprice < 1000 THEN printf('price %.2f too small', p_retailprice) END AS reason FROM part""")
def geometry_rejection(spark, sf):
    """The first failing rule wins; plausible objects have no reason."""
    rules = [
        ((F.col("p_size") > 40) & F.contains(F.col("p_type"), F.lit("A")), F.format_string("height %.2f m too large", F.col("p_size") / 20.0)),
        (F.col("p_retailprice") < 1000, F.format_string("price %.2f too small", F.col("p_retailprice"))),
    ]
    reason = F.coalesce(*[F.when(bad, text) for bad, text in rules])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), reason.alias("reason"))


@query("""WITH g AS (SELECT l_suppkey AS id, count(*) n, avg(l_discount) s FROM lineitem GROUP BY 1), f AS (SELECT id, CAST(n < 590 AS INT) AS small, CAST(s < 0.049 AS INT) AS weak FROM g)
SELECT id, CASE WHEN weak = 1 THEN 'likely_wrong' WHEN small = 1 THEN 'review' ELSE 'ok' END AS status, concat_ws(',', CASE WHEN small = 1 THEN 'few_points' END, CASE WHEN weak = 1 THEN 'low_score' END) AS reasons FROM f""")
def quality_flags(spark, sf):
    """All reasons are kept; the status is that of the worst."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("s"))
    small, weak = F.col("n") < 590, F.col("s") < 0.049
    reasons = F.array_compact(F.array(F.when(small, "few_points"), F.when(weak, "low_score")))
    return g.select("id", F.when(weak, "likely_wrong").when(small, "review").otherwise("ok").alias("status"), F.array_join(reasons, ",").alias("reasons"))


@query("SELECT p_partkey AS id, CASE WHEN r <= 1 THEN round(0.35 + 0.65*(1-r), 6) ELSE 0.05 END AS w FROM (SELECT p_partkey, greatest(abs(p_size-25)/20.0::DOUBLE, abs(p_retailprice-1300)/500.0::DOUBLE) r FROM part)")
def centre_weights(spark, sf):
    r = F.greatest(F.abs(F.col("p_size") - 25) / 20.0, F.abs(F.col("p_retailprice") - 1300) / 500.0)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(r <= 1, F.round(0.35 + 0.65 * (1 - r), 6)).otherwise(0.05).alias("w"))


@query("""SELECT c_custkey, n_nationkey AS node FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN ' ' || lower(n) ELSE n END AS said FROM (SELECT c_custkey, n_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey)) LEFT JOIN nation ON lower(trim(said)) = lower(n_name)""")
def name_resolution(spark, sf):
    """Names resolve whatever their case and the blanks around them; unknown names give null."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise(F.col("n_name")).alias("said"))
    return c.join(n, F.lower(F.trim("said")) == F.lower("n_name"), "left").select("c_custkey", F.col("n_nationkey").alias("node"))
