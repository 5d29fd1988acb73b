"""Queries over rasters of 25 by 25 cells laid out from nations, and over voxels of embeddings' points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.functions.text import natural_key
from stoa.operators import grids, holes, outlines, points, rooms
from stoa.plans.clouds import CLOUD, cloud
from stoa.plans.registry import query
from stoa.session import table, written

SHAPE = (25, 25)
GRID = "gd AS (SELECT CAST(n_nationkey AS BIGINT) AS r, CAST(j AS BIGINT) AS c FROM nation, range(25) t(j))"
BLOBS = "((r BETWEEN 3 AND 10 AND c BETWEEN 3 AND 10 AND NOT (r BETWEEN 5 AND 8 AND c BETWEEN 5 AND 8)) OR (r BETWEEN 14 AND 20 AND c BETWEEN 14 AND 20 AND NOT (r BETWEEN 16 AND 18 AND c >= 16)) OR (r = 22 AND c IN (2, 8)) OR (r = 23 AND c = 3))"
LINES = "((r % 8 = 0 OR c % 8 = 0) AND NOT (r % 8 = 0 AND c % 8 = 4 AND r BETWEEN 8 AND 16) AND NOT (c = 16 AND r % 8 BETWEEN 2 AND 6))"
NEAR = "b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1"


def grid(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("col"))


def cells(spark, sf, rule: str):
    return grid(spark, sf).withColumns({"r": F.col("row"), "c": F.col("col")}).where(rule).select("row", "col")


def _out(df):
    return df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


FLOOD = "{0} AS (SELECT r, c FROM {1} WHERE r IN (0, 24) OR c IN (0, 24) UNION SELECT a.r, a.c FROM {1} a JOIN {0} b ON abs(a.r - b.r) + abs(a.c - b.c) = 1)"


@query(f"""WITH RECURSIVE {GRID}, em AS (SELECT * FROM gd WHERE NOT {BLOBS}), {FLOOD.format('fl', 'em')} SELECT r AS "row", c AS col FROM gd WHERE (r, c) NOT IN (SELECT (r, c) FROM fl)""")
def filled_holes(spark, sf):
    """Cells and what they enclose."""
    return _out(holes.fill_holes(cells(spark, sf, BLOBS), SHAPE))


CLOSED = f"oc AS (SELECT * FROM gd WHERE {BLOBS}), di AS (SELECT DISTINCT a.r, a.c FROM gd a JOIN oc b ON {NEAR}), cl AS (SELECT a.r, a.c FROM di a JOIN di b ON {NEAR} GROUP BY 1, 2 HAVING count(*) = (least(a.r+1,24)-greatest(a.r-1,0)+1)*(least(a.c+1,24)-greatest(a.c-1,0)+1))"


@query(f"""WITH RECURSIVE {GRID}, {CLOSED}, em AS (SELECT * FROM gd WHERE (r, c) NOT IN (SELECT (r, c) FROM cl)), {FLOOD.format('fl', 'em')}, fi AS (SELECT * FROM gd WHERE (r, c) NOT IN (SELECT (r, c) FROM fl)),
rc AS (SELECT r, c, r AS r0, c AS c0 FROM fi UNION SELECT a.r, a.c, b.r0, b.c0 FROM fi a JOIN rc b ON {NEAR}), nm AS (SELECT r, c, count(*) AS n FROM rc GROUP BY 1, 2) SELECT r AS "row", c AS col FROM nm WHERE n >= 4""")
def cleaned_mask(spark, sf):
    """A mask closed, filled, and without components of under four cells."""
    return _out(rooms.cleaned(cells(spark, sf, BLOBS), 1, SHAPE))


@query(f"""WITH RECURSIVE {GRID}, oc AS (SELECT * FROM gd WHERE {BLOBS}), rc AS (SELECT r, c, r AS r0, c AS c0 FROM oc UNION SELECT a.r, a.c, b.r0, b.c0 FROM oc a JOIN rc b ON {NEAR}), nm AS (SELECT r, c, min(r0 * 25 + c0) AS k FROM rc GROUP BY 1, 2),
sz AS (SELECT k, count(*) AS n FROM nm GROUP BY 1 HAVING count(*) >= 2) SELECT row_number() OVER (ORDER BY n DESC, k) AS rank, CAST(k AS BIGINT) AS component, n AS cells FROM sz ORDER BY rank LIMIT 3""")
def largest_components(spark, sf):
    """The three largest components of two cells or more: that many are asked for."""
    named = grids.components(cells(spark, sf, BLOBS), 25)
    n = named.groupBy("component").agg(F.count(F.lit(1)).alias("cells")).where("cells >= 2").orderBy(F.desc("cells"), "component").limit(3)
    return n.select(F.row_number().over(Window.orderBy(F.desc("cells"), "component")).cast("long").alias("rank"), F.col("component").cast("long").alias("component"), "cells")


WALLS = """pc AS (SELECT l_partkey * 7 % 24 AS r, l_orderkey % 30 AS c, l_quantity / 20.0::DOUBLE AS z FROM lineitem WHERE l_partkey * 7 % 24 % 8 = 0 OR l_orderkey % 30 % 10 = 0 OR (l_quantity < 12 AND l_partkey % 5 = 0)),
sl AS (SELECT CAST(floor((z - 0.35) / (1.95 / 5)) AS BIGINT) AS k, r, c, count(*) AS n FROM pc WHERE z >= 0.35 AND z < 2.3 GROUP BY 1, 2, 3), ok AS (SELECT k FROM sl GROUP BY 1 HAVING sum(n) >= 100 AND count(*) / 720.0 BETWEEN 0.0005 AND 0.75),
pe AS (SELECT r, c, count(*) / (SELECT count(*) FROM ok) AS p FROM sl WHERE k IN (SELECT k FROM ok) GROUP BY 1, 2)"""


def _room_points(spark, sf):
    r, c = F.col("l_partkey") * 7 % 24, F.col("l_orderkey") % 30
    p = table(spark, sf, "lineitem").where((r % 8 == 0) | (c % 10 == 0) | ((F.col("l_quantity") < 12) & (F.col("l_partkey") % 5 == 0)))
    return p.select(r.alias("row"), c.alias("col"), (F.col("l_quantity") / 20.0).alias("z"))


@query(f'WITH {WALLS} SELECT r AS "row", c AS col, round(p, 6) AS persistence FROM pe')
def wall_persistence(spark, sf):
    p = rooms.wall_persistence(_room_points(spark, sf), 0.35, 2.3, 5, (24, 30))
    return p.select("row", "col", F.round("persistence", 6).alias("persistence"))


@query(f"""WITH {WALLS}, g2 AS (SELECT r, c FROM range(24) a(r), range(30) b(c)), hi AS (SELECT DISTINCT r, c FROM pc WHERE z BETWEEN 1.1 AND 2.3), hd AS (SELECT DISTINCT a.r, a.c FROM g2 a JOIN hi b ON {NEAR}),
cu AS (SELECT DISTINCT r, c FROM pc WHERE z BETWEEN 0.15 AND 0.75 EXCEPT SELECT r, c FROM hd), bo AS (SELECT r, c FROM pe WHERE p >= 0.45 AND NOT (p < 0.55 AND (r, c) IN (SELECT (r, c) FROM cu))),
d1 AS (SELECT DISTINCT a.r, a.c FROM g2 a JOIN bo b ON {NEAR}), d2 AS (SELECT DISTINCT a.r, a.c FROM g2 a JOIN d1 b ON {NEAR}), er AS (SELECT a.r, a.c FROM d2 a JOIN d2 b ON {NEAR} GROUP BY 1, 2 HAVING count(*) = (least(a.r+1,23)-greatest(a.r-1,0)+1)*(least(a.c+1,29)-greatest(a.c-1,0)+1))
SELECT CAST(r AS BIGINT) AS "row", CAST(c AS BIGINT) AS col FROM er""")
def wall_map(spark, sf):
    """Walls of a floor: cells occupied over most of the height, less clutter near the floor."""
    return _out(rooms.walls(_room_points(spark, sf), 0.0, 0.35, 2.3, 5, (24, 30), 0.45))


@query(f"""WITH RECURSIVE {GRID}, wl AS (SELECT * FROM gd WHERE {LINES}), rm AS (SELECT r // 8 * 10 + c // 8 AS room, r, c FROM gd WHERE r % 8 > 0 AND c % 8 > 0 AND r < 24 AND c < 24),
wd AS (SELECT DISTINCT m.room AS near, a.r, a.c FROM gd a JOIN rm m ON m.r BETWEEN a.r - 2 AND a.r + 2 AND m.c BETWEEN a.c - 2 AND a.c + 2), sp AS (SELECT DISTINCT least(room, near) AS a, greatest(room, near) AS b, m.r, m.c FROM rm m JOIN wd ON wd.r = m.r AND wd.c = m.c WHERE room <> near),
pr AS (SELECT a, b FROM sp LEFT JOIN wl ON wl.r = sp.r AND wl.c = sp.c GROUP BY 1, 2 HAVING count(*) >= 4 AND count(wl.r) / count(*) <= 0.18 AND (a + b) % 4 > 0), ed AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), re AS (SELECT room AS a, room AS b FROM rm UNION SELECT re.a, ed.b FROM re JOIN ed ON ed.a = re.b)
SELECT a AS room, min(b) AS merged FROM re GROUP BY 1""".replace(" AND (a + b) % 4 > 0", ""))
def merged_rooms(spark, sf):
    """Rooms joined where their boundary is long enough and mostly open."""
    wall = cells(spark, sf, LINES)
    r, c = F.col("row"), F.col("col")
    own = grid(spark, sf).where((r % 8 > 0) & (c % 8 > 0) & (r < 24) & (c < 24)).select((F.floor(r / 8) * 10 + F.floor(c / 8)).alias("room"), "row", "col")
    return rooms.merged_rooms(own, wall, 2, 4, 0.18, SHAPE)


@query(f"""WITH RECURSIVE {GRID}, wl AS (SELECT * FROM gd WHERE {LINES} AND c <> 16), rm AS (SELECT r // 13 AS room, r, c FROM gd), fr AS (SELECT * FROM rm WHERE (r, c) NOT IN (SELECT (r, c) FROM wl)), rc AS (SELECT room, r, c, r * 25 + c AS k FROM fr UNION SELECT a.room, a.r, a.c, b.k FROM fr a JOIN rc b ON a.room = b.room AND {NEAR}),
nm AS (SELECT room, r, c, min(k) AS k FROM rc GROUP BY 1, 2, 3), sz AS (SELECT room, k, row_number() OVER (PARTITION BY room ORDER BY count(*) DESC, k) AS part, count(*) OVER (PARTITION BY room) AS parts FROM nm GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT room, r AS "row", c AS col, CAST(part AS INT) AS part FROM nm JOIN sz USING (room, k) WHERE parts > 1 UNION ALL SELECT room, r, c, 0 FROM rm WHERE room NOT IN (SELECT room FROM sz WHERE parts > 1)""")
def split_rooms(spark, sf):
    """Rooms cut into parts along the walls within them."""
    own = grid(spark, sf).select(F.floor(F.col("row") / 13).alias("room"), "row", "col")
    return rooms.split_rooms(own, cells(spark, sf, LINES).where("col <> 16"), 0, 20, SHAPE)


FIELD = f"""oc AS (SELECT r, c, r * 25 + c AS site FROM gd WHERE {BLOBS}), fd AS (SELECT a.r, a.c, min({{'d2': (a.r-b.r)*(a.r-b.r) + (a.c-b.c)*(a.c-b.c), 'site': b.site}}) AS m FROM gd a, oc b WHERE (a.r-b.r)*(a.r-b.r) + (a.c-b.c)*(a.c-b.c) <= 36 GROUP BY 1, 2)"""


@query(f'WITH {GRID}, {FIELD} SELECT r AS "row", c AS col, CAST(m.d2 AS BIGINT) AS d2, CAST(m.site AS BIGINT) AS site FROM fd')
def distance_field(spark, sf):
    """The squared distance of each cell to the nearest occupied one within six cells, and which that is."""
    f = rooms.distances(cells(spark, sf, BLOBS), 6, SHAPE)
    return f.select(*[F.col(c).cast("long").alias(c) for c in ("row", "col", "d2", "site")])


@query(f'WITH {GRID}, {FIELD} SELECT a.r AS "row", a.c AS col FROM fd a JOIN fd b ON {NEAR} GROUP BY 1, 2, a.m.d2 HAVING a.m.d2 >= 4 AND a.m.d2 = max(b.m.d2)')
def skeleton_cells(spark, sf):
    """Ridges of the distance field: cells no nearer to an obstacle than any neighbour."""
    return _out(rooms.ridges(rooms.distances(cells(spark, sf, BLOBS), 6, SHAPE), 4))


@query(f'WITH {GRID}, {FIELD} SELECT a.r AS "row", a.c AS col FROM fd a JOIN fd b ON {NEAR} GROUP BY 1, 2, a.m.d2 HAVING a.m.d2 >= 9 AND min(b.m.site // 250) <> max(b.m.site // 250)')
def voronoi_cells(spark, sf):
    """Cells where the areas of two bodies of obstacles meet."""
    f = rooms.distances(cells(spark, sf, BLOBS), 6, SHAPE).withColumn("site", F.floor(F.col("site") / 250))
    return _out(rooms.site_borders(f, 9))


@query(f"""WITH {GRID}, oc AS (SELECT * FROM gd WHERE {BLOBS}), rd AS (SELECT DISTINCT a.r, a.c FROM gd a JOIN oc b ON {NEAR}), bl AS (SELECT r, c FROM gd WHERE r >= 20), al AS (SELECT r, c, 'blue' AS colour FROM bl UNION ALL SELECT r, c, 'red' FROM rd WHERE (r, c) NOT IN (SELECT (r, c) FROM bl))
SELECT r AS "row", c AS col, colour, CAST(z AS INT) AS layer FROM al, range(3) t(z)""")
def overlay_layers(spark, sf):
    """A map as layers of coloured points: obstacles thickened, less the unknown area, at three heights."""
    blue = grid(spark, sf).where("row >= 20").withColumn("colour", F.lit("blue"))
    red = grids.dilate(cells(spark, sf, BLOBS), 1, SHAPE).join(blue, ["row", "col"], "left_anti").withColumn("colour", F.lit("red"))
    both = blue.unionByName(red.select("row", "col", "colour"))
    return both.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "colour", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("layer"))


@query(f"""WITH {GRID}, ar AS (SELECT r // 9 AS area, (max(c) - min(c) + 1) * 0.5::DOUBLE AS w, (max(r) - min(r) + 1) * 0.5::DOUBLE AS h FROM gd WHERE r % 9 < 1 + r // 9 * 3 AND c < 12 GROUP BY 1), kd AS (SELECT area, CASE WHEN greatest(w, h) / least(w, h) >= 2.5 AND least(w, h) <= 3 THEN 'corridor' ELSE 'common_area' END AS kind FROM ar)
SELECT area, kind || '_' || row_number() OVER (PARTITION BY kind ORDER BY area) AS name FROM kd""")
def leftover_areas(spark, sf):
    """Areas left over: corridors if long and narrow, numbered within their kind. One row an area is ranked."""
    own = grid(spark, sf).where("row % 9 < 1 + floor(row / 9) * 3 and col < 12").select(F.floor(F.col("row") / 9).alias("area"), "row", "col")
    side = lambda a: (F.max(a) - F.min(a) + 1) * 0.5
    a = own.groupBy("area").agg(side("col").alias("w"), side("row").alias("h"))
    thin = (F.greatest("w", "h") / F.least("w", "h") >= 2.5) & (F.least("w", "h") <= 3)
    k = a.select("area", F.when(thin, "corridor").otherwise("common_area").alias("kind"))
    return k.select("area", F.concat("kind", F.lit("_"), F.row_number().over(Window.partitionBy("kind").orderBy("area")).cast("string")).alias("name"))


@query(f"WITH {GRID}, {CLOUD}, pc AS (SELECT point_id, CAST(least(24, greatest(0, floor((x + 0.3) / 0.6 * 25))) AS BIGINT) AS r, CAST(least(24, greatest(0, floor((y + 0.3) / 0.6 * 25))) AS BIGINT) AS c FROM cloud) SELECT point_id, r // 8 * 10 + c // 8 AS room FROM pc JOIN gd USING (r, c) WHERE NOT {LINES}")
def cell_label_points(spark, sf):
    """Points by the label of the cell that they fall in; those in walls have none."""
    spot = lambda a: F.least(F.lit(24), F.greatest(F.lit(0), F.floor((F.col(a) + 0.3) / 0.6 * 25))).cast("long")
    p = cloud(spark, sf).select("point_id", spot("x").alias("row"), spot("y").alias("col"))
    free = grid(spark, sf).join(cells(spark, sf, LINES), ["row", "col"], "left_anti")
    return p.join(free, ["row", "col"]).select("point_id", (F.floor(F.col("row") / 8) * 10 + F.floor(F.col("col") / 8)).alias("room"))


VOX = f"{CLOUD}, vx AS (SELECT point_id, label, CAST(floor(x/0.1) AS BIGINT) AS vx, CAST(floor(y/0.1) AS BIGINT) AS vy, CAST(floor(z/0.1) AS BIGINT) AS vz FROM cloud), vo AS (SELECT DISTINCT label, vx, vy, vz FROM vx)"
NEAR3 = "a.label = b.label AND abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1"
VCOMP = f"{VOX}, rc AS (SELECT label, vx, vy, vz, vx AS x0, vy AS y0, vz AS z0 FROM vo UNION SELECT a.label, a.vx, a.vy, a.vz, b.x0, b.y0, b.z0 FROM vo a JOIN rc b ON {NEAR3}), nm AS (SELECT label, vx, vy, vz, min((x0 * 1000 + y0) * 1000 + z0) AS k FROM rc GROUP BY 1, 2, 3, 4)"


@query(f"""WITH RECURSIVE {VCOMP}, sz AS (SELECT label, k, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, k) AS rank FROM vx JOIN nm USING (label, vx, vy, vz) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT point_id, label, rank FROM vx JOIN nm USING (label, vx, vy, vz) JOIN sz USING (label, k) WHERE rank <= 3""")
def voxel_instances(spark, sf):
    """Instances of each label: its points' voxels joined over 26 neighbours, the three largest of two points or more."""
    return rooms.ranked_instances(rooms.voxel_components(cloud(spark, sf), ["label"], 0.1), "label", 2, 3)


@query(f"WITH RECURSIVE {VCOMP}, sd AS (SELECT label, k FROM vx JOIN nm USING (label, vx, vy, vz) WHERE point_id % 100 = 7) SELECT DISTINCT point_id FROM vx JOIN nm USING (label, vx, vy, vz) JOIN sd USING (label, k)")
def seeded_component(spark, sf):
    """Points of the voxel components that the seeds lie in."""
    named = rooms.voxel_components(cloud(spark, sf), ["label"], 0.1)
    seeds = named.where("point_id % 100 = 7").select("label", "component").distinct()
    return named.join(seeds, ["label", "component"], "left_semi").select("point_id")


@query(f"""WITH RECURSIVE {CLOUD}, nr AS (SELECT a.label, a.point_id, b.point_id AS other FROM cloud a JOIN cloud b ON a.label = b.label AND round((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), 12) <= 0.0225), co AS (SELECT label, point_id FROM nr GROUP BY 1, 2 HAVING count(*) >= 4),
ce AS (SELECT point_id AS a, other AS b FROM nr WHERE point_id IN (SELECT point_id FROM co) AND other IN (SELECT point_id FROM co)), re AS (SELECT point_id AS a, point_id AS b FROM co UNION SELECT re.a, ce.b FROM re JOIN ce ON ce.a = re.b), cl AS (SELECT a AS other, min(b) AS cluster FROM re GROUP BY 1),
rc AS (SELECT point_id, arg_min(cluster, {{'o': nr.other <> point_id, 'i': nr.other}}) AS cluster FROM nr JOIN cl USING (other) GROUP BY 1) SELECT point_id, label, cluster FROM cloud LEFT JOIN rc USING (point_id)""")
def dbscan_clusters(spark, sf):
    """Density clusters of each mask's points; noise has none."""
    return rooms.dbscan(cloud(spark, sf), ["label"], 0.15, 4)


COSTS = "cs AS (SELECT n_regionkey AS pic, n_nationkey AS q, t, (n_nationkey * 7 + t * 13 + n_nationkey * t * 5) % 17 + (n_nationkey * 5 + t) / 1000.0::DOUBLE AS cost FROM nation, range(4) r(t))"


@query(f"""WITH {COSTS}, al AS (SELECT a.pic, [a.q, b.q, c.q, d.q] AS qs, a.cost + b.cost + c.cost + d.cost AS total FROM cs a JOIN cs b ON a.pic = b.pic AND b.t = 1 AND b.q <> a.q JOIN cs c ON a.pic = c.pic AND c.t = 2 AND c.q NOT IN (a.q, b.q) JOIN cs d ON a.pic = d.pic AND d.t = 3 AND d.q NOT IN (a.q, b.q, c.q) WHERE a.t = 0),
bs AS (SELECT pic, arg_min(qs, round(total, 9)) AS qs FROM al GROUP BY 1) SELECT pic, CAST(unnest(qs) AS BIGINT) AS query, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS target FROM bs""")
def mask_assignment(spark, sf):
    """Targets matched to queries at least cost, a matrix a picture."""
    k, t = F.col("n_nationkey"), F.col("t")
    n = table(spark, sf, "nation").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3))))
    c = n.select(F.col("n_regionkey").alias("pic"), k.cast("long").alias("query"), t.cast("long").alias("target"), ((k * 7 + t * 13 + k * t * 5) % 17 + (k * 5 + t) / 1000.0).alias("cost"))
    return rooms.assigned(c, "pic")


@query("""WITH rm AS (SELECT 'Room ' || s_suppkey AS room, s_suppkey AS id, s_suppkey * 37 % 1000 / 20.0::DOUBLE AS x FROM supplier), pr AS (SELECT a.room AS room, b.room AS other, b.id AS oid, abs(a.x - b.x) AS gap FROM rm a JOIN rm b ON a.id <> b.id AND abs(a.x - b.x) <= 0.75),
rk AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY round(gap, 9), oid) AS rank FROM pr) SELECT room, other, rank FROM rk WHERE rank <= 6""")
def natural_neighbours(spark, sf):
    """Each room's six nearest within reach, ties in natural order of their names: the cap is the operator."""
    k = F.col("s_suppkey")
    r = table(spark, sf, "supplier").select(F.concat(F.lit("Room "), k.cast("string")).alias("room"), (k * 37 % 1000 / 20.0).alias("x"))
    p = points.nearest_in_line(r, "room", "x", 0.75, 6, natural_key(F.col("room")), 9)
    return p.select(F.col("item").alias("room"), "other", "rank")


@query("SELECT n_regionkey AS room, 4 AS corners FROM nation GROUP BY 1")
def simplified_outlines(spark, sf):
    """Outlines with fewer corners: points along the sides of a square go."""
    side = [[float(x), 0.0] for x in range(5)] + [[5.0, float(y)] for y in range(5)] + [[float(x), 5.0] for x in range(5, 0, -1)] + [[0.0, float(y)] for y in range(5, 0, -1)]
    ring = F.array(*[F.array(F.lit(x) + F.col("n_regionkey"), F.lit(y)) for x, y in side])
    r = table(spark, sf, "nation").select("n_regionkey").distinct()
    return r.select(F.col("n_regionkey").alias("room"), F.size(rooms.simplified_column(ring, 0.2)).alias("corners"))


ARROW = "[[0, 0], [w, 0], [w, w], [w / 2, w / 3], [0, w]]"
CELL_M, ROWS = 0.25, 60
SITES = f"""rm AS (SELECT p_partkey AS room, p_partkey // 100 * 8.0::DOUBLE + p_partkey * 37 % 70 / 10.0::DOUBLE AS x, p_partkey * 53 % 110 / 10.0::DOUBLE AS y, 1 + p_size / 20.0::DOUBLE AS w FROM part), wd AS (SELECT (max(p_partkey) // 100 + 1) * 32 + 40 AS width FROM part)"""


def _sites(spark, sf):
    k = F.col("p_partkey")
    t = table(spark, sf, "part").select(k.alias("room"), (F.floor(k / 100) * 8.0 + k * 37 % 70 / 10.0).alias("x"), (k * 53 % 110 / 10.0).alias("y"), (1 + F.col("p_size") / 20.0).alias("w"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    ring = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + w), F.array(x + w / 2, y + w / 3), F.array(x, y + w))
    width = (table(spark, sf, "part").agg(F.max("p_partkey").alias("m")).first()["m"] // 100 + 1) * 32 + 40
    return t.withColumn("polygon", ring), width


@query(f"""WITH {SITES}, mb AS (SELECT l_partkey AS room, least(greatest(CAST(floor(l_quantity / 3.0 / {CELL_M}) AS BIGINT), 0), {ROWS - 1}) AS r, least(greatest(CAST(floor((l_partkey // 100 * 8 + l_suppkey % 8) / {CELL_M}) AS BIGINT), 0), (SELECT width FROM wd) - 1) AS c FROM lineitem WHERE l_partkey % 3 = 0),
co AS (SELECT room, k, round_even((x + px) / {CELL_M}, 0) AS cx, round_even((y + py) / {CELL_M}, 0) AS cy FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k, unnest([0, w, w, w / 2, 0]) AS px, unnest([0, 0, w, w / 3, w]) AS py FROM rm WHERE room NOT IN (SELECT room FROM mb))),
sd AS (SELECT a.room, a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS byy FROM co a JOIN co b ON a.room = b.room AND b.k = a.k % 5 + 1), bb AS (SELECT room, CAST(min(cx) AS BIGINT) AS c0, CAST(max(cx) AS BIGINT) AS c1, CAST(min(cy) AS BIGINT) AS r0, CAST(max(cy) AS BIGINT) AS r1 FROM co GROUP BY 1),
gr AS (SELECT room, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM bb)),
ins AS (SELECT room, r, c FROM gr JOIN sd USING (room) WHERE (ay <= r) <> (byy <= r) GROUP BY 1, 2, 3 HAVING count(*) FILTER (round(ax + (r - ay) * (bx - ax) / (byy - ay), 9) > c) % 2 = 1 OR count(*) FILTER (round(ax + (r - ay) * (bx - ax) / (byy - ay), 9) = c) > 0),
st AS (SELECT *, greatest(abs(bx - ax), abs(byy - ay)) AS n FROM sd), ln AS (SELECT *, unnest(range(0, CAST(n AS BIGINT) + 1)) AS k FROM st),
eg AS (SELECT room, CAST(floor(round(ay + (byy - ay) * k / greatest(n, 1), 9) + 0.5) AS BIGINT) AS r, CAST(floor(round(ax + (bx - ax) * k / greatest(n, 1), 9) + 0.5) AS BIGINT) AS c FROM ln)
SELECT room, r AS "row", c AS col FROM mb UNION SELECT room, r, c FROM ins WHERE r BETWEEN 0 AND {ROWS - 1} AND c BETWEEN 0 AND (SELECT width FROM wd) - 1 UNION SELECT room, r, c FROM eg WHERE r BETWEEN 0 AND {ROWS - 1} AND c BETWEEN 0 AND (SELECT width FROM wd) - 1""")
def room_masks(spark, sf):
    """Cells of each room: those of its points where it lists any, else those of its polygon, here concave ones."""
    sites, width = _sites(spark, sf)
    li = table(spark, sf, "lineitem").where("l_partkey % 3 = 0").withColumn("point_id", F.monotonically_increasing_id())
    li = written(li.select("point_id", F.col("l_partkey").alias("room"), (F.floor(F.col("l_partkey") / 100) * 8.0 + F.col("l_suppkey") % 8).alias("x"), (F.col("l_quantity") / 3.0).alias("y")), "room-points")
    return rooms.room_masks(sites, "room", "polygon", li.select("room", "point_id"), li.select("point_id", "x", "y"), (0.0, 0.0), CELL_M, (ROWS, width))


TRACKS = "ce AS (SELECT DISTINCT l_partkey AS r, CAST(floor(l_quantity) AS BIGINT) AS c FROM lineitem WHERE l_suppkey % 4 = 0 AND l_linenumber <= 3), ob AS (SELECT DISTINCT o_custkey AS r, o_orderkey % 50 AS c FROM orders WHERE o_orderkey % 10 = 0)"


@query(f"""WITH RECURSIVE {TRACKS}, rc AS (SELECT r, c, r AS r0, c AS c0 FROM ce UNION SELECT a.r, a.c, b.r0, b.c0 FROM ce a JOIN rc b ON a.r BETWEEN b.r - 1 AND b.r + 1 AND a.c BETWEEN b.c - 1 AND b.c + 1), nm AS (SELECT r, c, min(r0 * 100 + c0) AS k FROM rc GROUP BY 1, 2),
ds AS (SELECT ob.r AS r1, ob.c AS c1, arg_min(k, (pow(nm.r - ob.r, 2) + pow(nm.c - ob.c, 2)) * 1e9 + nm.r * 100 + nm.c) AS k FROM ob JOIN nm ON pow(nm.r - ob.r, 2) + pow(nm.c - ob.c, 2) <= 6.25 GROUP BY 1, 2)
SELECT r AS "row", c AS col FROM nm WHERE k IN (SELECT k FROM ds)""")
def paths_by_objects(spark, sf):
    """Path cells whose component is the nearest of some object within two and a half cells."""
    li = table(spark, sf, "lineitem").where("l_suppkey % 4 = 0 and l_linenumber <= 3").select(F.col("l_partkey").alias("row"), F.floor("l_quantity").alias("col")).distinct()
    o = table(spark, sf, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("row"), (F.col("o_orderkey") % 50).alias("col"))
    return rooms.paths_near(li, o, 2.5, 100)


BORDERS = """ce AS (SELECT DISTINCT l_suppkey AS room, CAST(floor(l_quantity) AS BIGINT) AS r, l_partkey % 40 AS c FROM lineitem),
sd AS (SELECT ce.room, (ce.r * 64 + ce.c) * 4 + k AS side, CASE WHEN e.room IS NOT NULL THEN (e.r * 64 + e.c) * 4 + (k + 3) % 4 WHEN a.room IS NOT NULL THEN (a.r * 64 + a.c) * 4 + k ELSE (ce.r * 64 + ce.c) * 4 + (k + 1) % 4 END AS nxt
FROM ce CROSS JOIN (VALUES (0, 0, 1, -1, 0), (1, 1, 0, 0, 1), (2, 0, -1, 1, 0), (3, -1, 0, 0, -1)) w(k, i, j, p, q) LEFT JOIN ce o ON o.room = ce.room AND o.r = ce.r + p AND o.c = ce.c + q
LEFT JOIN ce a ON a.room = ce.room AND a.r = ce.r + i AND a.c = ce.c + j LEFT JOIN ce e ON e.room = ce.room AND e.r = ce.r + i + p AND e.c = ce.c + j + q WHERE o.room IS NULL),
wk AS (SELECT room, side AS s0, side, nxt FROM sd UNION ALL SELECT w.room, w.s0, sd.side, sd.nxt FROM wk w JOIN sd ON sd.room = w.room AND sd.side = w.nxt WHERE w.nxt > w.s0),
st AS (SELECT room, s0, nxt, side // 4 % 64 AS c, side // 256 AS r, nxt // 4 % 64 AS c2, nxt // 256 AS r2 FROM wk),
lp AS (SELECT room, s0, sum(c * r2 - c2 * r) / 2.0::DOUBLE AS area, sum(sqrt(pow(c2 - c, 2) + pow(r2 - r, 2))) AS length FROM st GROUP BY 1, 2 HAVING count(*) FILTER (nxt = s0) > 0)"""


@query(f"WITH RECURSIVE {BORDERS}, bs AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY area DESC, s0) AS rn FROM lp) SELECT room, area, round(length, 6) AS length FROM bs WHERE rn = 1")
def room_outlines(spark, sf):
    """The area within the outline of each room's largest region, and the outline's length, traced over rasters of ragged cells."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("room"), F.floor("l_quantity").alias("row"), (F.col("l_partkey") % 40).alias("col"))
    found = outlines.outlines(li, "room", 64)
    after = lambda i: F.get("outline", (i + 1) % F.size("outline"))
    steps = F.transform("outline", lambda p, i: F.hypot(after(i)[0] - p[0], after(i)[1] - p[1]))
    return found.select("room", "area", F.round(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x), 6).alias("length"))


def _snap_sql(reach: int, least: int) -> str:
    """Four sides in turn, each as those before left it."""
    steps, names = [], [f"{a}{k}" for k in range(4) for a in "xy"]
    for i in range(4):
        j, on = (i + 1) % 4, f"q{i}"
        dx, dy = f"abs(x{j} - x{i})", f"abs(y{j} - y{i})"
        v = f"({dy} > 0 AND {dx} / {dy} < 0.35)"
        steps.append(f"s{i} AS (SELECT *, {v} AS v, NOT {v} AND {dx} > 0 AND {dy} / {dx} < 0.35 AS h, round_even((CASE WHEN {v} THEN x{i} + x{j} ELSE y{i} + y{j} END) * 0.5 / {CELL_M}, 0) AS m, floor((CASE WHEN {v} THEN least(y{i}, y{j}) ELSE least(x{i}, x{j}) END) / {CELL_M}) AS lo, ceil((CASE WHEN {v} THEN greatest(y{i}, y{j}) ELSE greatest(x{i}, x{j}) END) / {CELL_M}) AS hi FROM {on})")
        steps.append(f"n{i} AS (SELECT room, c AS line, count(*) AS n FROM s{i} JOIN wl ON c BETWEEN m - {reach} AND m + {reach} AND r BETWEEN lo AND hi WHERE v GROUP BY 1, 2 UNION ALL SELECT room, r, count(*) FROM s{i} JOIN wl ON r BETWEEN m - {reach} AND m + {reach} AND c BETWEEN lo AND hi WHERE h GROUP BY 1, 2)")
        steps.append(f"b{i} AS (SELECT room, arg_max(line, n * 1000000 - line) * {CELL_M}::DOUBLE AS lv FROM n{i} GROUP BY 1 HAVING max(n) >= {least})")
        new = [f"CASE WHEN {'v' if a == 'x' else 'h'} THEN coalesce(lv, {a}{k}) ELSE {a}{k} END AS {a}{k}" if k in (i, j) else f"{a}{k}" for k in range(4) for a in "xy"]
        steps.append(f"q{i + 1} AS (SELECT room, {', '.join(new)} FROM s{i} LEFT JOIN b{i} USING (room))")
    cross = " + ".join(f"x{k} * y{(k + 1) % 4} - x{(k + 1) % 4} * y{k}" for k in range(4))
    low, high = (lambda a: f"least({', '.join(f'{a}{k}' for k in range(4))})"), (lambda a: f"greatest({', '.join(f'{a}{k}' for k in range(4))})")
    kept = ", ".join(f"CASE WHEN big THEN e.{n} ELSE q0.{n} END AS {n}" for n in names)
    return f"{', '.join(steps)}, en AS (SELECT *, abs({cross}) / 2 > 0.5 AS big FROM q4), fi AS (SELECT room, {kept} FROM en e JOIN q0 USING (room)) SELECT room, round(abs({cross}) / 2, 6) AS area, round({low('x')}, 6) AS x_low, round({high('x')}, 6) AS x_high, round({low('y')}, 6) AS y_low, round({high('y')}, 6) AS y_high FROM fi"


@query(f"""WITH {SITES}, q0 AS (SELECT room, x AS x0, y AS y0, x + w AS x1, y + w / 9 AS y1, x + w + w / 7 AS x2, y + w AS y2, x + w / 2 AS x3, y + w AS y3 FROM rm),
wl AS (SELECT DISTINCT least(greatest(CAST(floor(l_quantity / 3.0 / {CELL_M}) AS BIGINT), 0), {ROWS - 1}) AS r, CAST(floor((l_partkey // 100 * 8 + l_suppkey % 8) / {CELL_M}) AS BIGINT) AS c FROM lineitem WHERE l_partkey % 100 < 12), {_snap_sql(3, 3)}""")
def wall_snapped_rooms(spark, sf):
    """Leaning four-sided rooms with their sides moved onto the wall lines beside them: what they cover then."""
    sites, width = _sites(spark, sf)
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    ring = F.array(F.array(x, y), F.array(x + w, y + w / 9), F.array(x + w + w / 7, y + w), F.array(x + w / 2, y + w))
    row = F.least(F.greatest(F.floor(F.col("l_quantity") / 3.0 / CELL_M), F.lit(0)), F.lit(ROWS - 1))
    wall = table(spark, sf, "lineitem").where("l_partkey % 100 < 12").select(row.alias("row"), F.floor((F.floor(F.col("l_partkey") / 100) * 8 + F.col("l_suppkey") % 8) / CELL_M).alias("col")).distinct()
    out = outlines.snapped_to_walls(sites.select("room", ring.alias("polygon")), "room", "polygon", wall, (0.0, 0.0), CELL_M, (ROWS, width), 0.75, 0.75)
    after = lambda i: F.get("polygon", (i + 1) % F.size("polygon"))
    twice = F.aggregate(F.transform("polygon", lambda p, i: p[0] * after(i)[1] - after(i)[0] * p[1]), F.lit(0.0), lambda s, v: s + v)
    side = lambda k: F.transform("polygon", lambda p: p[k])
    return out.select("room", F.round(F.abs(twice) / 2, 6).alias("area"), *[F.round(f(side(k)), 6).alias(f"{a}_{n}") for k, a in enumerate("xy") for n, f in (("low", F.array_min), ("high", F.array_max))])
