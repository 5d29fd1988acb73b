"""Queries over plans, motions and robot messages: plan steps are order lines, messages are events and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.operators import splines
from stoa.plans.registry import query
from stoa.session import table
from stoa.sources.las import byte_colour, with_colours


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 3 THEN 'executed' WHEN l_linenumber = 3 THEN 'current' ELSE 'pending' END AS status FROM lineitem")
def step_status(spark, sf):
    n = F.col("l_linenumber")
    status = F.when(n < 3, "executed").when(n == 3, "current").otherwise("pending")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", status.alias("status"))


@query("""WITH m AS (SELECT conv_id, list(role || turn::VARCHAR ORDER BY turn, role) AS markers FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(CASE WHEN list_contains(markers, 'assistant1') THEN list_slice(markers, list_position(markers, 'assistant1') + 1, len(markers)) ELSE markers END, ',') AS left_over FROM m""")
def progress_trim(spark, sf):
    """What is left of a path after the first occurrence of the marker last reached; all of it if that isn't on the path."""
    order = F.array_sort(F.collect_list(F.struct("turn", "role")))
    m = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(order, lambda s: F.concat(s["role"], s["turn"].cast("string"))).alias("markers"))
    at = F.array_position("markers", F.lit("assistant1")).cast("int")
    return m.select("conv_id", F.array_join(F.when(at > 0, F.slice("markers", at + 1, F.size("markers"))).otherwise(F.col("markers")), ",").alias("left_over"))


@query("""WITH p AS (SELECT event_id, value AS x, value / 2 AS y, (event_id % 63) / 10.0::DOUBLE AS theta, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE event_id % 7 - 3.5::DOUBLE END AS turn, CASE WHEN event_id % 4 = 0 THEN 0.0005 ELSE event_id % 5 + 0.5::DOUBLE END AS forward FROM events),
q AS (SELECT *, CASE WHEN abs(turn) > 0.001 THEN theta + turn - 2 * pi() * floor((theta + turn) / (2 * pi())) ELSE theta END AS to_theta FROM p)
SELECT event_id, round(to_theta, 6) AS to_theta, round(CASE WHEN abs(forward) > 0.001 THEN x + forward * cos(to_theta) ELSE x END, 6) AS to_x, round(CASE WHEN abs(forward) > 0.001 THEN y + forward * sin(to_theta) ELSE y END, 6) AS to_y FROM q""")
def relative_motion(spark, sf):
    """The pose to go to: first a turn, then straight on; a leg of at most 0.001 is left out."""
    e = F.col("event_id")
    p = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("x"), (F.col("value") / 2).alias("y"), ((e % 63) / 10.0).alias("theta"),
        F.when(e % 3 == 0, 0.0).otherwise(e % 7 - 3.5).alias("turn"), F.when(e % 4 == 0, 0.0005).otherwise(e % 5 + 0.5).alias("forward"),
    )
    full = 2 * F.pi()
    q = p.withColumn("to_theta", F.when(F.abs("turn") > 0.001, F.col("theta") + F.col("turn") - full * F.floor((F.col("theta") + F.col("turn")) / full)).otherwise(F.col("theta")))
    ahead = F.when(F.abs("forward") > 0.001, F.col("forward")).otherwise(0.0)
    return q.select("event_id", F.round("to_theta", 6).alias("to_theta"), F.round(F.col("x") + ahead * F.cos("to_theta"), 6).alias("to_x"), F.round(F.col("y") + ahead * F.sin("to_theta"), 6).alias("to_y"))


@query("SELECT event_id, round((event_id % 640 - 320) * value / 600.0::DOUBLE, 6) AS x, round((event_id % 480 - 240) * value / 610.0::DOUBLE, 6) AS y, value AS z FROM events")
def pixel_deprojection(spark, sf):
    """Pixels with a depth as camera coordinates."""
    along = lambda n, centre, focal: F.round((F.col("event_id") % n - centre) * F.col("value") / focal, 6)
    return table(spark, sf, "events").select("event_id", along(640, 320, 600.0).alias("x"), along(480, 240, 610.0).alias("y"), F.col("value").alias("z"))


SAID = "CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'Device or Resource BUSY: ' || event_type WHEN event_id % 4 = 2 THEN NULL ELSE event_type || ' failed' END"


@query(f"SELECT event_id, coalesce(said <> '' AND NOT contains(lower(said), 'resource busy'), false) AS reset FROM (SELECT event_id, {SAID} AS said FROM events)")
def audio_error_reset(spark, sf):
    """Whether a message calls for a device reset: not if it is empty or only says that the device is busy."""
    said = table(spark, sf, "events").select("event_id", F.expr(SAID).alias("said"))
    return said.select("event_id", F.coalesce((F.col("said") != "") & ~F.contains(F.lower("said"), F.lit("resource busy")), F.lit(False)).alias("reset"))


NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
LINE = "CASE WHEN p_partkey % 5 = 0 THEN '# none' WHEN p_partkey % 5 = 1 THEN 'a9 Centroid = [' || p_size || ', -' || p_partkey || '.5, 1e1] box=[1,2]' WHEN p_partkey % 5 = 2 THEN 'a9 [' || p_size || ' ' || p_partkey || ']' WHEN p_partkey % 5 = 3 THEN p_size || ' ' || p_partkey || ' 7 8' ELSE 'only ' || p_size END"


@query(f"""WITH l AS (SELECT p_partkey AS line, trim({LINE}) AS s FROM part), n AS (SELECT line, regexp_extract_all(coalesce(nullif(regexp_extract(s, '(?i)centroid\\s*=\\s*\\[([^\\]]+)\\]', 1), ''), nullif(regexp_extract(s, '\\[([^\\]]+)\\]', 1), ''), s), '{NUMBER}') AS v FROM l WHERE s <> '' AND NOT starts_with(s, '#'))
SELECT line, CAST(CASE WHEN len(v) >= 3 THEN v[-3] ELSE v[1] END AS DOUBLE) AS x, CAST(CASE WHEN len(v) >= 3 THEN v[-2] ELSE v[2] END AS DOUBLE) AS y FROM n WHERE len(v) >= 2""")
def object_xy_lines(spark, sf):
    """Places from lines of text: the numbers of a centroid, else of the first brackets, else of the line.

    Of three or more numbers the third-last and second-last count, of two both; other lines give no place.
    """
    lines = table(spark, sf, "part").select(F.col("p_partkey").alias("line"), F.trim(F.expr(LINE)).alias("s")).where("s <> '' and not startswith(s, '#')")
    inner = lambda pattern: F.nullif(F.regexp_extract("s", pattern, 1), F.lit(""))
    within = F.coalesce(inner(r"(?i)centroid\s*=\s*\[([^\]]+)\]"), inner(r"\[([^\]]+)\]"), F.col("s"))
    v = lines.select("line", F.regexp_extract_all(within, F.lit(f"({NUMBER})")).alias("v")).where("size(v) >= 2")
    three = F.size("v") >= 3
    pick = lambda far, near: F.when(three, F.try_element_at("v", F.lit(far))).otherwise(F.element_at("v", near)).cast("double")
    return v.select("line", pick(-3, 1).alias("x"), pick(-2, 2).alias("y"))


@query("SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS first_id, count(*) OVER (PARTITION BY embedding) AS copies FROM embeddings")
def unique_embeddings(spark, sf):
    """Each vector with the first that equals it: equal vectors are counted before the join back."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    firsts = e.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return e.join(firsts, e["embedding"].eqNullSafe(firsts["embedding"])).select("vec_id", "first_id", "copies")


@query("""WITH p AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), a AS (SELECT CAST(floor(x) AS BIGINT) i, CAST(floor(y) AS BIGINT) j, avg(x) x, avg(y) y FROM p GROUP BY 1, 2),
b AS (SELECT CAST(floor(i / 2.0::DOUBLE) AS BIGINT) i, CAST(floor(j / 2.0::DOUBLE) AS BIGINT) j, avg(x) x, avg(y) y FROM a GROUP BY 1, 2),
c AS (SELECT CAST(floor(i / 2.0::DOUBLE) AS BIGINT) i, CAST(floor(j / 2.0::DOUBLE) AS BIGINT) j, avg(x) x, avg(y) y FROM b GROUP BY 1, 2)
SELECT level, i, j, round(x + 1e-9::DOUBLE, 6) AS x, round(y + 1e-9::DOUBLE, 6) AS y FROM (SELECT 0 AS level, * FROM a UNION ALL SELECT 1, * FROM b UNION ALL SELECT 2, * FROM c)""")
def centroid_pyramid(spark, sf):
    """Mean of the points of each voxel, then means of two-by-two cells, level by level: each level reduces before its shuffle.

    Rounding starts 1e-9 above the mean, so that ties of the seventh decimal go up whatever the order of summing.
    """
    p = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    means = lambda df, i, j: df.groupBy(F.floor(i).alias("i"), F.floor(j).alias("j")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    level, found = means(p, F.col("x"), F.col("y")), None
    for n in range(3):
        rows = level.select(F.lit(n).alias("level"), "i", "j", F.round(F.col("x") + 1e-9, 6).alias("x"), F.round(F.col("y") + 1e-9, 6).alias("y"))
        found = rows if found is None else found.unionByName(rows)
        level = means(level, F.col("i") / 2, F.col("j") / 2)
    return found


@query("""WITH m AS (SELECT max(greatest(p_size * 900, p_size * 40, p_partkey % 256)) AS top FROM part)
SELECT p_partkey AS point_id, round(p_size * 900 / s, 6) AS r, round(p_size * 40 / s, 6) AS g, round(p_partkey % 256 / s, 6) AS b, CAST(least(floor(p_size * 900 / 256.0::DOUBLE), 255) AS INT) AS red_byte FROM part, (SELECT CASE WHEN top > 255 THEN 65535.0::DOUBLE / 255 ELSE 1.0::DOUBLE END AS s FROM m)""")
def wide_colours(spark, sf):
    """Two-byte colours brought to 0 to 255, by the largest of the cloud, and on their own."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_size") * 900).alias("red"), (F.col("p_size") * 40).alias("green"), (F.col("p_partkey") % 256).alias("blue"))
    return with_colours(p).select("point_id", *[F.round(c, 6).alias(c) for c in "rgb"], byte_colour(F.col("red")).alias("red_byte"))


@query("""WITH m AS (SELECT min(p_size) low, max(p_size) top FROM part) SELECT p_partkey AS point_id, round((p_size - low) * 255.0::DOUBLE / (top - low), 6) AS gray FROM part, m""")
def intensity_gray(spark, sf):
    """Intensity between its least and largest value as gray, for clouds without colours."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").alias("intensity"))
    return with_colours(p, colours=None).select("point_id", F.round("r", 6).alias("gray"))


@query()
def spline_resample(spark, sf):
    """Clamped splines at 100 Hz through the balances of each nation's customers, a knot each 0.1 s; then 5 held rows."""
    c = table(spark, sf, "customer")
    at = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    knots = c.select(F.col("c_nationkey").alias("traj"), (at / 10.0).alias("t"), (F.col("c_acctbal") / 1000).alias("y"))
    return splines.held(splines.resampled(knots, ["traj"]), ["traj"], 5)
