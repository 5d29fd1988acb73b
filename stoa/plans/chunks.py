"""Queries over chunks: parts are points of a plane, regions areas, chunks boxes in them; line items are predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.operators import chunks, sampling
from stoa.operators.quantiles import quantiles
from stoa.plans.clouds import PARTS, plane
from stoa.plans.registry import query
from stoa.session import table

BOXES = "bx AS (SELECT n_nationkey AS chunk_id, n_nationkey % 5 * 10.0::DOUBLE AS x0, n_nationkey % 5 * 10.0::DOUBLE + 10 AS x1, 900 + n_nationkey // 5 * 220.0::DOUBLE AS y0, 900 + n_nationkey // 5 * 220.0::DOUBLE + 220 AS y1 FROM nation)"


def boxes(spark, sf):
    k = F.col("n_nationkey")
    x, y = k % 5 * 10.0, 900 + F.floor(k / 5) * 220.0
    return table(spark, sf, "nation").select(k.alias("chunk_id"), x.alias("x0"), (x + 10).alias("x1"), y.alias("y0"), (y + 220).alias("y1"))


HALO = f"{PARTS}, {BOXES}, cm AS (SELECT chunk_id, point_id, x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND point_id % 4 > 0 AS is_core FROM pts JOIN bx ON x BETWEEN x0 - 3 AND x1 + 3 AND y BETWEEN y0 - 3 AND y1 + 3)"


def members(spark, sf):
    met = chunks.in_boxes(plane(spark, sf), boxes(spark, sf), 3.0)
    core = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")) & (F.col("point_id") % 4 > 0)
    return met.select("chunk_id", "point_id", core.alias("is_core"))


@query(f"WITH {HALO} SELECT chunk_id, point_id, is_core FROM cm")
def chunk_halo_members(spark, sf):
    """Points in each chunk's box and halo; core ones are in the box itself and in the chunk's room."""
    return members(spark, sf)


@query(f"WITH {HALO}, co AS (SELECT DISTINCT point_id FROM cm WHERE is_core) SELECT point_id, point_id IN (SELECT point_id FROM co) AS in_core FROM pts")
def core_marks(spark, sf):
    """Which points are core of some chunk."""
    core = members(spark, sf).where("is_core").select("point_id").distinct().withColumn("_c", F.lit(True))
    return plane(spark, sf).select("point_id").join(core, "point_id", "left").select("point_id", F.coalesce("_c", F.lit(False)).alias("in_core"))


@query(f"WITH {PARTS}, {BOXES} SELECT chunk_id, count(point_id) AS n FROM bx LEFT JOIN pts ON x BETWEEN x0 - 1.5 AND x1 + 1.5 AND y BETWEEN y0 - 1.5 AND y1 + 1.5 GROUP BY 1")
def halo_counts(spark, sf):
    return chunks.box_counts(plane(spark, sf), boxes(spark, sf), "chunk_id", 1.5)


GATHER = f"""{HALO}, lc AS (SELECT chunk_id, point_id, is_core, row_number() OVER (PARTITION BY chunk_id ORDER BY point_id) - 1 AS local_idx FROM cm),
pd AS (SELECT l_suppkey % 25 AS chunk_id, l_partkey % 40 AS local_idx, l_linenumber AS label, l_discount * 8 AS score FROM lineitem)"""


def gathered(spark, sf):
    order = Window.partitionBy("chunk_id").orderBy("point_id")  # a chunk has at most its cap of points
    local = members(spark, sf).withColumn("local_idx", F.row_number().over(order) - 1)
    li = table(spark, sf, "lineitem")
    pred = li.select((F.col("l_suppkey") % 25).alias("chunk_id"), (F.col("l_partkey") % 40).alias("local_idx"), F.col("l_linenumber").alias("label"), (F.col("l_discount") * 8).alias("score"))
    return pred.join(local, ["chunk_id", "local_idx"])


@query(f"WITH {GATHER} SELECT point_id, label, count(*) AS votes, round(sum(greatest(0, least(score, 1)) * CASE WHEN is_core THEN 1 ELSE 0.05 END), 6) AS weight FROM pd JOIN lc USING (chunk_id, local_idx) GROUP BY 1, 2")
def gathered_votes(spark, sf):
    """Predictions meet their chunk's members by place, and so their points: votes and weights of each label."""
    w = F.greatest(F.lit(0.0), F.least("score", F.lit(1.0))) * F.when(F.col("is_core"), 1.0).otherwise(0.05)
    return gathered(spark, sf).groupBy("point_id", "label").agg(F.count(F.lit(1)).alias("votes"), F.round(F.sum(w), 6).alias("weight"))


@query(f"WITH {GATHER}, pi AS (SELECT p_partkey AS point_id, p_partkey // 20 AS instance FROM part WHERE p_partkey % 6 > 0) SELECT instance, count(*) AS n, round(avg(score), 6) AS score FROM pd JOIN lc USING (chunk_id, local_idx) JOIN pi USING (point_id) GROUP BY 1")
def instance_predictions(spark, sf):
    """Predictions of the points of each instance; points of none take no part."""
    own = table(spark, sf, "part").where("p_partkey % 6 > 0").select(F.col("p_partkey").alias("point_id"), F.floor(F.col("p_partkey") / 20).alias("instance"))
    return gathered(spark, sf).join(own, "point_id").groupBy("instance").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


@query("""WITH s AS (SELECT p_partkey AS point_id, row_number() OVER (ORDER BY md5(concat_ws(':', p_partkey, '3')), p_partkey) AS rn FROM part), k AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS place FROM s WHERE rn <= 100)
SELECT l_orderkey, l_partkey AS point_id, place FROM lineitem JOIN k ON point_id = l_partkey""")
def sample_hits(spark, sf):
    """Which global points are in a sample of a hundred, and where. The sample is small by its definition."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"))
    some = p.withColumn("_d", sampling.draw(["point_id"], 3)).orderBy("_d", "point_id").limit(100).drop("_d")
    placed = some.withColumn("place", (F.row_number().over(Window.orderBy("point_id")) - 1).cast("long"))  # a hundred rows
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("point_id")).join(placed, "point_id")


MOST, HALO_M, SIDE, DEPTH = 150, 1.0, 2.0, 14


def _split_sql() -> str:
    out = [f"{PARTS}, o0 AS (SELECT 'r' AS box, 0.0::DOUBLE AS x0, 60.0::DOUBLE AS x1, 800.0::DOUBLE AS y0, 2200.0::DOUBLE AS y1)"]
    for d in range(DEPTH):
        inside = "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"
        out.append(f"f{d} AS (SELECT o.*, (SELECT count(*) FROM pts WHERE x BETWEEN o.x0 - {HALO_M} AND o.x1 + {HALO_M} AND y BETWEEN o.y0 - {HALO_M} AND o.y1 + {HALO_M}) AS n FROM o{d} o WHERE EXISTS (SELECT 1 FROM pts WHERE {inside}))")
        out.append(f"l{d} AS (SELECT * FROM f{d} WHERE n > {MOST} AND greatest(x1-x0, y1-y0) > {SIDE})")
        out.append(f"m{d} AS (SELECT box, x0, x1, y0, y1, quantile_cont(CASE WHEN x1-x0 >= y1-y0 THEN x ELSE y END, 0.5) AS mid FROM l{d} JOIN pts ON {inside} GROUP BY ALL)")
        out.append(f"a{d} AS (SELECT *, x1-x0 >= y1-y0 AS wide, CASE WHEN x1-x0 >= y1-y0 THEN CASE WHEN mid <= x0+1e-4 OR mid >= x1-1e-4 THEN (x0+x1)/2 ELSE mid END ELSE CASE WHEN mid <= y0+1e-4 OR mid >= y1-1e-4 THEN (y0+y1)/2 ELSE mid END END AS c FROM m{d})")
        out.append(f"o{d + 1} AS (SELECT box || '0' AS box, x0, CASE WHEN wide THEN c ELSE x1 END AS x1, y0, CASE WHEN wide THEN y1 ELSE c END AS y1 FROM a{d} UNION ALL SELECT box || '1', CASE WHEN wide THEN c ELSE x0 END, x1, CASE WHEN wide THEN y0 ELSE c END, y1 FROM a{d})")
    kept = " UNION ALL ".join(f"SELECT * FROM f{d} WHERE NOT (n > {MOST} AND greatest(x1-x0, y1-y0) > {SIDE})" for d in range(DEPTH))
    return "WITH " + ", ".join(out) + f" SELECT box, round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM ({kept})"


@query(_split_sql())
def median_split(spark, sf):
    """An area split at medians until each box holds at most 150 points with its halo."""
    area = spark.createDataFrame([("r", 0.0, 60.0, 800.0, 2200.0)], "box string, x0 double, x1 double, y0 double, y1 double")
    return chunks.split_boxes(plane(spark, sf), area, HALO_M, MOST, SIDE).select("box", *[F.round(c, 6).alias(c) for c in chunks.BOX])


@query(f"WITH {PARTS}, rm AS (SELECT r_regionkey AS room, r_regionkey * 12.0::DOUBLE AS x0, r_regionkey * 12.0::DOUBLE + 8 AS x1 FROM region) SELECT 'room_' || room AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS points FROM rm JOIN pts ON x BETWEEN x0 AND x1 AND y < 1500 GROUP BY 1")
def area_specs(spark, sf):
    """Areas of rooms: the extent and number of the points in each; rooms without points have none."""
    k = F.col("r_regionkey")
    rooms = table(spark, sf, "region").select(k.alias("room"), (k * 12.0).alias("x0"), (k * 12.0 + 8).alias("x1"), F.lit(800.0).alias("y0"), F.lit(1500.0).alias("y1"))
    p = plane(spark, sf).where("y < 1500")
    met = chunks.in_boxes(p, rooms)
    return met.groupBy(F.concat(F.lit("room_"), F.col("room").cast("string")).alias("area")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("points"))


@query("SELECT l_suppkey AS room, round(quantile_cont(l_extendedprice, 0.02), 6) AS floor_z, round(quantile_cont(l_extendedprice, 0.98), 6) AS top_z, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def floor_estimate(spark, sf):
    """Each room's floor and top as exact percentiles of its heights, by narrowing histograms."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("room"), F.col("l_extendedprice").alias("z"))
    q = quantiles(li, ["room"], "z", [0.02, 0.98]).groupBy("room").agg(F.round(F.max(F.when(F.col("share") < 0.5, F.col("v"))), 6).alias("floor_z"), F.round(F.max(F.when(F.col("share") > 0.5, F.col("v"))), 6).alias("top_z"))
    return q.join(li.groupBy("room").agg(F.min("z").alias("low"), F.max("z").alias("high")), "room")


@query("""SELECT count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (votes = 0) AS unlabelled, count(*) FILTER (votes < 5) AS weak, array_to_string(list(chunk_id ORDER BY chunk_id) FILTER (status = 'failed'), ',') AS failed_chunks
FROM (SELECT p_partkey AS chunk_id, CASE WHEN p_partkey % 97 = 0 THEN 'failed' ELSE 'done' END AS status, p_size % 20 AS votes FROM part)""")
def run_summary(spark, sf):
    """What a run's report counts: failed chunks by name, points without a label or with few votes."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_partkey") % 97 == 0).alias("failed"), (F.col("p_size") % 20).alias("votes"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("chunk_id")))), lambda x: x.cast("string")), ",")
    return p.agg(F.count_if("failed").alias("failed"), F.count_if(F.col("votes") == 0).alias("unlabelled"), F.count_if(F.col("votes") < 5).alias("weak"), names.alias("failed_chunks"))


SEED_BOX, WITHIN = (20.0, 22.0, 1000.0, 1050.0), (0.0, 51.0, 900.0, 2200.0)
_FAR = f"greatest(0, {SEED_BOX[0]} - x, x - {SEED_BOX[1]}, {SEED_BOX[2]} - y, y - {SEED_BOX[3]})"


@query(f"""WITH RECURSIVE {PARTS}, mg AS (SELECT CASE WHEN {_FAR} = 0 OR (x BETWEEN {WITHIN[0]} AND {WITHIN[1]} AND y BETWEEN {WITHIN[2]} AND {WITHIN[3]}) THEN {_FAR} END AS m FROM pts), nn AS (SELECT count(*) // 10 + 5 AS wanted, count(*) // 5 AS most FROM pts),
st AS (SELECT s AS m, (SELECT count(*) FROM mg WHERE mg.m <= s) AS n FROM (SELECT unnest([0.25 * pow(2, k) FOR k IN range(13)]) AS s)), hi AS (SELECT min(m) AS m FROM st, nn WHERE n >= wanted),
b AS (SELECT 0 AS i, coalesce((SELECT max(st.m) FROM st WHERE st.m < hi.m), 0)::DOUBLE AS low, hi.m::DOUBLE AS high FROM hi UNION ALL
SELECT i + 1, CASE WHEN (SELECT count(*) FROM mg WHERE mg.m <= (b.low + b.high) / 2) >= wanted THEN low ELSE (low + high) / 2 END, CASE WHEN (SELECT count(*) FROM mg WHERE mg.m <= (b.low + b.high) / 2) >= wanted THEN (low + high) / 2 ELSE high END FROM b, nn WHERE i < 28),
hs AS (SELECT high, min(i) AS i, (SELECT count(*) FROM mg WHERE mg.m <= high) AS n FROM b WHERE i > 0 AND high < (SELECT m FROM hi) GROUP BY 1), lo AS (SELECT low AS m, (SELECT count(*) FROM mg WHERE mg.m <= low) AS n FROM (SELECT DISTINCT low FROM b UNION SELECT m FROM st WHERE m < (SELECT m FROM hi) UNION SELECT 0)),
pk AS (SELECT coalesce((SELECT arg_max(high, i) FROM hs, nn WHERE n <= most), (SELECT arg_max(m, n * 1e6 - m) FROM lo, nn WHERE n <= most OR m = 0)) AS m)
SELECT round(greatest({WITHIN[0]}, {SEED_BOX[0]} - m), 6) AS x0, round(least({WITHIN[1]}, {SEED_BOX[1]} + m), 6) AS x1, round(greatest({WITHIN[2]}, {SEED_BOX[2]} - m), 6) AS y0, round(least({WITHIN[3]}, {SEED_BOX[3]} + m), 6) AS y1 FROM pk""")
def grown_context(spark, sf):
    """A box widened within its bounds until a tenth of all points and five more are in it, and at most a fifth."""
    p = plane(spark, sf)
    n = p.count()
    box = chunks.grown_box(p, SEED_BOX, n // 10, n // 5, WITHIN, spare=5)
    return spark.createDataFrame([tuple(round(float(v), 6) for v in box)], "x0 double, x1 double, y0 double, y1 double")
