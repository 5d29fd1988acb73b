"""Queries over edits, classes and exports: line items are an edit log over parts, part types their classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.operators import edits, points, sampling
from stoa.plans.clouds import CLOUD, ROOM, cloud, plane
from stoa.plans.objects import ITEMS, items
from stoa.plans.registry import query
from stoa.session import scratch, table

LOG = f"""lg AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey AS id, ['relabel','set_active','set_inactive','class_active','class_inactive'][l_suppkey % 5 + 1] AS op, it.label AS base, 'new_' || l_suppkey % 4 AS label FROM lineitem JOIN it ON it.id = l_partkey WHERE l_orderkey % 3 = 0)"""


def log(spark, sf):
    ops = F.array(*[F.lit(o) for o in ("relabel", "set_active", "set_inactive", "class_active", "class_inactive")])
    k = F.col("l_suppkey")
    li = table(spark, sf, "lineitem").where("l_orderkey % 3 = 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("id"), F.element_at(ops, (k % 5 + 1).cast("int")).alias("op"), F.concat(F.lit("new_"), (k % 4).cast("string")).alias("label"))
    return li.join(items(spark, sf).select("id", F.col("label").alias("base")), "id")


@query(f"""WITH {ITEMS}, {LOG}, rl AS (SELECT id, arg_max(label, {{'s': seq, 'l': label}}) AS nl FROM lg WHERE op = 'relabel' GROUP BY 1), so AS (SELECT id, max({{'s': seq, 'o': op = 'set_active'}}) AS m FROM lg WHERE op IN ('set_active', 'set_inactive') GROUP BY 1), sc AS (SELECT base, max({{'s': seq, 'o': op = 'class_active'}}) AS m FROM lg WHERE op IN ('class_active', 'class_inactive') GROUP BY 1)
SELECT it.id, coalesce(nl, label) AS label, coalesce(CASE WHEN so.m IS NULL THEN sc.m.o WHEN sc.m IS NULL OR so.m > sc.m THEN so.m.o ELSE sc.m.o END, active) AS active, nl IS NOT NULL AS relabelled FROM it LEFT JOIN rl USING (id) LEFT JOIN so USING (id) LEFT JOIN sc ON sc.base = it.label""")
def edit_log(spark, sf):
    """Instances after all edits: labels of their own, states of their own or of their class, the last one each."""
    return edits.edited(items(spark, sf).select("id", "label", "active"), log(spark, sf))


@query(f"WITH {CLOUD} SELECT point_id, label = 3 AS same, label = 3 OR label = 0 AS loose, true AS everything FROM cloud")
def pick_modes(spark, sf):
    c = cloud(spark, sf).select("point_id", F.col("label").cast("string").alias("l"))
    return c.select("point_id", *[edits.mode_kept(m, F.col("l"), F.lit("3"), "0").alias(n) for m, n in (("same", "same"), ("loose", "loose"), ("all", "everything"))])


@query("""SELECT p_partkey AS id, l IN ('wall','floor','ceiling') OR contains(l, 'other') AS background, l IN ('wall','floor') OR contains(l, 'other') AS no_instances, starts_with(l, 'other') AS ignored FROM (SELECT p_partkey, lower(trim([' Wall','floor','Ceiling','other furniture','chair','Another'][p_partkey % 6 + 1])) AS l FROM part)""")
def class_kinds(spark, sf):
    names = F.array(*[F.lit(v) for v in (" Wall", "floor", "Ceiling", "other furniture", "chair", "Another")])
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("l"))
    return p.select("id", *[c.alias(n) for n, c in edits.class_sets(F.col("l")).items()])


@query(f"WITH {CLOUD}, d AS (SELECT point_id, row_number() OVER (PARTITION BY label ORDER BY round(x*x+y*y+z*z, 12), point_id) AS rank, label FROM cloud) SELECT label, point_id FROM d WHERE rank <= 20")
def nearest_twenty(spark, sf):
    """Of each scene the twenty points nearest to the origin: the size of the crop is the operator's."""
    d = F.round(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"), 12)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(d, "point_id"))
    return cloud(spark, sf).withColumn("rank", rank).where("rank <= 20").select("label", "point_id")


EDGES = "ge AS (SELECT l_partkey AS src, l_suppkey AS dst, ['contains','near','on','functional'][l_linenumber % 4 + 1] AS relation FROM lineitem)"


@query(f"WITH {ITEMS}, {EDGES} SELECT src, dst, relation FROM ge JOIN it a ON a.id = src JOIN it b ON b.id = dst WHERE relation IN ('near', 'on') AND a.active AND b.active")
def object_edges(spark, sf):
    """Spatial edges whose both ends are active objects."""
    k = F.col("l_linenumber") % 4 + 1
    kinds = F.array(*[F.lit(v) for v in ("contains", "near", "on", "functional")])
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.element_at(kinds, k.cast("int")).alias("relation")).where("relation in ('near', 'on')")
    live = items(spark, sf).where("active").select("id")
    return e.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi")


@query(f"WITH {ITEMS} SELECT src, dst, relation FROM (SELECT room AS src, 'o' || id AS dst, 'contains' AS relation FROM it)")
def graph_round_trip(spark, sf):
    """A graph saved as nodes and edges and read again: edges whose ends are nodes."""
    i = items(spark, sf)
    path = scratch(spark, "graph")
    name = F.concat(F.lit("o"), F.col("id").cast("string"))
    i.select(F.col("room").alias("node")).distinct().unionByName(i.select(name.alias("node"))).write.parquet(f"{path}/nodes")
    i.select(F.col("room").alias("src"), name.alias("dst"), F.lit("contains").alias("relation")).write.parquet(f"{path}/edges")
    nodes, e = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    return e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "relation")


@query(f"WITH {ITEMS}, rm AS (SELECT DISTINCT room FROM it), al AS (SELECT 0 AS k, '' AS a, 0 AS b, 'floor' AS what UNION ALL SELECT 1, room, 0, room FROM rm UNION ALL SELECT 2, room, id, 'o' || id FROM it) SELECT what, 'n' || (row_number() OVER (ORDER BY k, a, b) - 1) AS node FROM al")
def node_ids(spark, sf):
    """Nodes named in order of insertion: the root, rooms, then objects. What is numbered is one graph's nodes."""
    i = items(spark, sf)
    floor = spark.range(1).select(F.lit(0).alias("k"), F.lit("").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("floor").alias("what"))
    rooms = i.select("room").distinct().select(F.lit(1).alias("k"), F.col("room").alias("a"), F.lit(0).cast("long").alias("b"), F.col("room").alias("what"))
    own = i.select(F.lit(2).alias("k"), F.col("room").alias("a"), F.col("id").alias("b"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("what"))
    nodes = floor.unionByName(rooms).unionByName(own).select("what", F.struct("k", "a", "b").alias("at"))
    return nodes.join(sampling.dense_ranks(nodes, "at", "number"), "at").select("what", F.concat(F.lit("n"), F.col("number").cast("string")).alias("node"))


@query("SELECT s_nationkey AS run, CASE WHEN count(*) FILTER (s_suppkey % 3 = 0) > 0 THEN 'edited' ELSE 'stitched' END AS source, CASE WHEN count(*) FILTER (s_suppkey % 2 = 0) > 0 THEN 'refined' ELSE 'raw' END AS rooms FROM supplier GROUP BY 1")
def resolved_sources(spark, sf):
    """Which artefacts of a run count: its newest edit else the stitched result, refined rooms else raw ones."""
    k = F.col("s_suppkey")
    pick = lambda rule, a, b: F.when(F.count_if(rule) > 0, a).otherwise(b)
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("run")).agg(pick(k % 3 == 0, "edited", "stitched").alias("source"), pick(k % 2 == 0, "refined", "raw").alias("rooms"))


@query("""SELECT event_id, round(goal, 6) AS goal, abs(round(d - 360 * floor((d + 180) / 360), 6)) <= 2 AS done FROM (SELECT event_id, (event_id % 1000 - 500) / 11.0::DOUBLE AS goal, (event_id % 1000 - 500) / 11.0::DOUBLE - value AS d FROM events)""")
def base_rotation(spark, sf):
    """The turn that a servo's place asks for, and whether what is left of it is within two degrees."""
    goal = (F.col("event_id") % 1000 - 500) / 11.0
    left = goal - F.col("value")
    rest = left - 360 * F.floor((left + 180) / 360)
    return table(spark, sf, "events").select("event_id", F.round(goal, 6).alias("goal"), (F.abs(F.round(rest, 6)) <= 2).alias("done"))


@query("""SELECT event_id, CASE WHEN n = 6 THEN 0 ELSE 3 END AS code, CASE WHEN n = 6 THEN round(event_id * 6 / 1000.0 + 0.015, 6) END AS total FROM (SELECT event_id, 6 - CAST(event_id % 4 = 0 AS INT) AS n FROM events)""")
def arm_states(spark, sf):
    """Joint angles of an arm from thousandths of degrees; a message with another number of joints is code 3."""
    k = F.col("event_id")
    joints = F.slice(F.array(*[(k + j).cast("long") for j in range(6)]), F.lit(1), F.when(k % 4 == 0, 5).otherwise(6))
    text = F.to_json(F.struct(joints.alias("joint"), F.lit(0).alias("arm_err")))
    read = table(spark, sf, "events").select("event_id", F.from_json(text, "joint array<long>, arm_err int").alias("m"))
    ok = F.size("m.joint") == 6
    total = F.aggregate("m.joint", F.lit(0.0), lambda s, x: s + x / 1000.0)
    return read.select("event_id", F.when(ok, 0).otherwise(3).alias("code"), F.when(ok, F.round(total, 6)).alias("total"))


def _room_sql() -> str:
    parts = []
    for (xi, yi), (xj, yj) in zip(ROOM, [ROOM[-1], *ROOM[:-1]], strict=True):
        parts.append(f"CAST((({yi} > y) <> ({yj} > y)) AND x < {xj - xi}::DOUBLE * (y - {yi}::DOUBLE) / ({yj - yi}::DOUBLE + 1e-12::DOUBLE) + {xi}::DOUBLE AS INT)")
    return f"WITH pts AS (SELECT p_partkey AS point_id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part) SELECT point_id, CASE WHEN ({' + '.join(parts)}) % 2 = 1 THEN 'room_a' WHEN x BETWEEN 0 AND 30 AND y < 1200 THEN 'room_b' ELSE 'floor' END AS room FROM pts"


@query(_room_sql())
def centroid_rooms(spark, sf):
    """The first room whose outline holds a centroid, else the floor."""
    x, y = F.col("x"), F.col("y")
    inside = points.in_polygon(x, y, ROOM, viewer=True)
    return plane(spark, sf).select("point_id", F.when(inside, "room_a").when(x.between(0, 30) & (y < 1200), "room_b").otherwise("floor").alias("room"))


@query(f"WITH {ITEMS} SELECT id, 'a photo of a ' || trim(regexp_replace(replace(lower(label), '_', ' '), '\\s+', ' ', 'g')) || ' in ' || room || CASE WHEN active THEN '' ELSE ' (hidden)' END AS prompt FROM it")
def object_prompts(spark, sf):
    """A sentence about each object, as a model is asked."""
    from stoa.functions.text import label_key

    hidden = F.when(F.col("active"), "").otherwise(" (hidden)")
    return items(spark, sf).select("id", F.concat(F.lit("a photo of a "), label_key(F.col("label")), F.lit(" in "), F.col("room"), hidden).alias("prompt"))


@query(f"""WITH {ITEMS}, cl AS (SELECT DISTINCT label FROM it) SELECT it.id, it.room, cl.label IS NOT NULL AS known, CAST(it.points AS BIGINT) AS points, st.n AS in_room FROM it LEFT JOIN cl ON cl.label = it.label JOIN (SELECT room, count(*) AS n FROM it GROUP BY 1) st ON st.room = it.room""")
def merged_attributes(spark, sf):
    """Objects with what their room and class tables add."""
    i = items(spark, sf)
    classes = i.select("label").distinct().withColumn("known", F.lit(True))
    rooms = i.groupBy("room").agg(F.count(F.lit(1)).alias("in_room"))
    return i.join(classes, "label", "left").join(rooms, "room").select("id", "room", F.coalesce("known", F.lit(False)).alias("known"), F.col("points").cast("long").alias("points"), "in_room")


@query("""SELECT p_partkey AS point_id, CASE WHEN p_partkey % 5 = 0 THEN 145 ELSE p_partkey % 7 * 30 END AS gray FROM part""")
def preview_colours(spark, sf):
    """Colours by instance; points of none are gray."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("point_id"), F.when(k % 5 == 0, F.lit(145).cast("long")).otherwise(k % 7 * 30).alias("gray"))


@query(f"WITH {ITEMS} SELECT label, count(*) FILTER (active AND points > 0) AS active, count(*) FILTER (id % 11 = 0) AS manual FROM it GROUP BY 1")
def session_counts(spark, sf):
    """What a saved session counts: active instances with points, and those made by hand."""
    live = F.col("active") & (F.col("points") > 0)
    return items(spark, sf).groupBy("label").agg(F.count_if(live).alias("active"), F.count_if(F.col("id") % 11 == 0).alias("manual"))
