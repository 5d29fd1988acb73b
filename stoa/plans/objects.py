"""Queries over labelled objects: parts are boxes with a label, a score and a room; suppliers are object instances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.functions import text as words
from stoa.operators import objects, relations
from stoa.plans.registry import query
from stoa.session import table

LABELS = ["door", "Elevator", "water_dispenser", "whiteboard", "chair", "notice_board", "cup", "side table", "projector screen", "water dispensor"]
ITEMS = f"""it AS (SELECT *, (x0+x1)/2 AS cx, (y0+y1)/2 AS cy, (z0+z1)/2 AS cz FROM (SELECT p_partkey AS id, {LABELS}[p_partkey % 10 + 1] AS label, p_partkey % 50 / 1000.0::DOUBLE AS score, p_partkey % 13 <> 0 AS active, p_size AS points, 'room_' || (p_partkey % 9) AS room,
 p_partkey // 2000 * 60 + (p_partkey * 37 % 1000) / 20.0::DOUBLE AS x0, p_partkey // 2000 * 60 + (p_partkey * 37 % 1000) / 20.0::DOUBLE + p_size / 10.0::DOUBLE AS x1, (p_partkey * 91 % 1000) / 20.0::DOUBLE AS y0, (p_partkey * 91 % 1000) / 20.0::DOUBLE + (p_partkey * 13 % 30) / 10.0::DOUBLE AS y1,
 (p_partkey % 4) / 2.0::DOUBLE AS z0, (p_partkey % 4) / 2.0::DOUBLE + (p_partkey * 7 % 50) / 10.0::DOUBLE AS z1 FROM part)),
ms AS (SELECT *, trim(regexp_replace(replace(lower(label), '_', ' '), '\\s+', ' ', 'g')) AS key, round(z1-z0,9) AS height, round(greatest(x1-x0,y1-y0),9) AS wide, round(least(x1-x0,y1-y0),9) AS deep, round(greatest(x1-x0,1e-6)*greatest(y1-y0,1e-6),9) AS area FROM it)"""


def items(spark, sf):
    k = F.col("p_partkey")
    x0, y0, z0 = F.floor(k / 2000) * 60 + (k * 37 % 1000) / 20.0, (k * 91 % 1000) / 20.0, (k % 4) / 2.0
    t = table(spark, sf, "part").select(
        k.alias("id"), F.element_at(F.array(*[F.lit(v) for v in LABELS]), (k % 10 + 1).cast("int")).alias("label"), (k % 50 / 1000.0).alias("score"), (k % 13 != 0).alias("active"), F.col("p_size").alias("points"),
        F.concat(F.lit("room_"), (k % 9).cast("string")).alias("room"), x0.alias("x0"), (x0 + F.col("p_size") / 10.0).alias("x1"), y0.alias("y0"), (y0 + (k * 13 % 30) / 10.0).alias("y1"), z0.alias("z0"), (z0 + (k * 7 % 50) / 10.0).alias("z1"),
    )
    return t.withColumns({f"c{a}": (F.col(f"{a}0") + F.col(f"{a}1")) / 2 for a in "xyz"})


SHAPE_SQL = "CASE " + " ".join(
    f"WHEN key = '{k}' AND height < {h0} THEN printf('{n} too short: height %.2fm', height) WHEN key = '{k}' AND height > {h1} THEN printf('{n} too tall: height %.2fm', height) WHEN key = '{k}' AND wide < {w0} THEN printf('{n} too narrow: width %.2fm', wide) "
    f"WHEN key = '{k}' AND wide > {w1} THEN printf('{n} too wide: width %.2fm', wide) WHEN key = '{k}' AND deep > {d1} THEN printf('{n} too {d}: depth %.2fm', deep) WHEN key = '{k}' AND area > {a1} THEN printf('{n} footprint too large: %.2fm2', area)"
    for k, (h0, h1, w0, w1, d1, a1, n, d) in objects.SHAPES.items()
) + " END"


@query(f"WITH {ITEMS} SELECT id, {SHAPE_SQL} AS reason FROM ms")
def shape_rejection(spark, sf):
    """Labels that their box can't have, by the rules of each label; the first failing rule is the reason."""
    return items(spark, sf).select("id", objects.shape_reason(words.label_key(F.col("label"))).alias("reason"))


def _flag_sql(label: str, chain: list) -> str:
    cases = " ".join(f"WHEN {m} {op} {bound} THEN {{'l': {level}, 's': printf('{text}{objects._SHOWN[m]}', {m})}}" for m, op, bound, level, text in chain)
    return f"CASE WHEN key <> '{label}' THEN NULL {cases} END"


FLAG_SQL = "list_filter([" + ", ".join(_flag_sql(k, chain) for k, chains in objects.QUALITY.items() for chain in [objects.SCORES, *chains]) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {ITEMS}, f AS (SELECT id, {FLAG_SQL} AS fl FROM ms) SELECT id, CASE coalesce(list_max(list_transform(fl, lambda x: x.l)), 0) WHEN 2 THEN 'likely_wrong' WHEN 1 THEN 'review' ELSE 'likely_correct' END AS status, array_to_string(list_transform(fl, lambda x: x.s), '; ') AS reasons FROM f")
def label_quality(spark, sf):
    """Quality flags of doors, elevators and water dispensers by score and box: every reason, and the worst as status."""
    q = items(spark, sf).select("id", objects.quality(words.label_key(F.col("label")), F.col("score")).alias("q"))
    return q.select("id", "q.status", F.array_join("q.reasons", "; ").alias("reasons"))


PAIR = """pp AS (SELECT a.id AS a, b.id AS b, a.cz AS acz, b.cz AS bcz, a.z0 AS az0, a.z1 AS az1, b.z0 AS bz0, b.z1 AS bz1, greatest(1e-9,(a.x1-a.x0)*(a.y1-a.y0)) AS aa, greatest(1e-9,(b.x1-b.x0)*(b.y1-b.y0)) AS ba,
 greatest(1e-9,(a.x1-a.x0)*(a.y1-a.y0)*(a.z1-a.z0)) AS av, greatest(1e-9,(b.x1-b.x0)*(b.y1-b.y0)*(b.z1-b.z0)) AS bv, greatest(1e-9,a.z1-a.z0) AS asp, greatest(1e-9,b.z1-b.z0) AS bsp,
 greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0) AS hi, greatest(least(a.z1,b.z1)-greatest(a.z0,b.z0),0) AS zi, sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2)) AS flat FROM it a JOIN it b ON a.id < b.id),
kn AS (SELECT *, CASE WHEN hi/(aa+1e-9) > 0.8 AND zi/asp > 0.8 AND bv/av > 3 THEN 'inside_ab' WHEN hi/(ba+1e-9) > 0.8 AND zi/bsp > 0.8 AND av/bv > 3 THEN 'inside_ba'
 WHEN hi/(aa+ba-hi+1e-9) > 0.3 AND abs(az0-bz1) < 0.15 AND acz > bcz THEN 'on_ab' WHEN hi/(aa+ba-hi+1e-9) > 0.3 AND abs(bz0-az1) < 0.15 AND bcz > acz THEN 'on_ba'
 WHEN flat < 2.5 AND acz-bcz > 0.3 THEN 'above_ab' WHEN flat < 2.5 AND acz-bcz < -0.3 THEN 'above_ba' WHEN sqrt(flat*flat+pow(acz-bcz,2)) < 2.5 THEN 'next_to_ab' END AS k FROM pp),
eg AS (SELECT CASE WHEN ends_with(k,'ab') THEN a ELSE b END AS src, CASE WHEN ends_with(k,'ab') THEN b ELSE a END AS dst, left(k, length(k)-3) AS relation, CASE WHEN starts_with(k,'above') THEN flat WHEN starts_with(k,'next') THEN sqrt(flat*flat+pow(acz-bcz,2)) ELSE 0 END AS far FROM kn WHERE k IS NOT NULL),
se AS (SELECT src, dst, relation FROM (SELECT *, row_number() OVER (PARTITION BY src, relation ORDER BY round(far,9), least(src,dst), greatest(src,dst)) AS rn FROM eg) WHERE relation IN ('inside','on') OR rn <= CASE relation WHEN 'above' THEN 8 ELSE 3 END)"""


@query(f"WITH {ITEMS}, {PAIR} SELECT src, dst, relation FROM se")
def spatial_relations(spark, sf):
    """Inside, on, above and next-to between object boxes, by the cascade and with the caps of the two loose ones."""
    return objects.spatial_edges(items(spark, sf), "id")


FIXTURE_SQL = " OR ".join(f"contains(lower(label), '{w}')" for w in objects.FIXTURES)


@query(f"WITH {ITEMS}, {PAIR} SELECT id, CASE WHEN {FIXTURE_SQL} OR id IN (SELECT dst FROM se WHERE relation = 'on') THEN 'asset' ELSE 'object' END AS role FROM it")
def object_roles(spark, sf):
    i = items(spark, sf)
    return objects.hierarchy(i, objects.spatial_edges(i, "id", wanted=("on",)), "id").select("id", "role")


@query(f"""WITH {ITEMS}, {PAIR}, rm AS (SELECT DISTINCT room FROM it) SELECT 'floor' AS src, room AS dst, 'contains' AS relation FROM rm UNION ALL SELECT room, 'o' || id, 'contains' FROM it UNION ALL SELECT 'o' || src, 'o' || dst, relation FROM se""")
def scene_graph_full(spark, sf):
    """The whole graph: the floor contains rooms, rooms contain objects, objects relate to each other."""
    i = items(spark, sf)
    rooms = i.select("room").distinct().select(F.lit("floor").alias("src"), F.col("room").alias("dst"), F.lit("contains").alias("relation"))
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    inside = i.select(F.col("room").alias("src"), name("id").alias("dst"), F.lit("contains").alias("relation"))
    return rooms.unionByName(inside).unionByName(objects.spatial_edges(i, "id").select(name("src").alias("src"), name("dst").alias("dst"), "relation"))


@query(f"WITH {ITEMS}, {PAIR}, sup AS (SELECT DISTINCT src FROM se WHERE relation = 'on') SELECT room AS parent, id AS child FROM it WHERE id NOT IN (SELECT src FROM sup) UNION ALL SELECT 'o' || dst, src FROM se WHERE relation = 'on'")
def readable_children(spark, sf):
    """Who holds whom in the readable tree: a room its objects that rest on nothing, an object those on it."""
    i = items(spark, sf)
    on = objects.spatial_edges(i, "id", wanted=("on",))
    direct = i.join(on.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select(F.col("room").alias("parent"), F.col("id").alias("child"))
    return direct.unionByName(on.select(F.concat(F.lit("o"), F.col("dst").cast("string")).alias("parent"), F.col("src").alias("child")))


@query(f"WITH {ITEMS} SELECT id, key IN {objects.READABLE} AS asset FROM ms")
def readable_assets(spark, sf):
    """Whether the readable tree takes a label for an asset."""
    return items(spark, sf).select("id", words.label_key(F.col("label")).isin(*objects.READABLE).alias("asset"))


KNOWN = "kr AS (SELECT 'room_' || r_regionkey AS room FROM region)"


@query(f"""WITH {ITEMS}, {KNOWN}, un AS (SELECT room, min(x0) AS x0, max(x1) AS x1, round(avg(cx),6) AS cx, count(*) AS objects FROM it WHERE room NOT IN (SELECT room FROM kr) GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY room) + (SELECT count(*) FROM kr) - 1 AS place FROM un""")
def synthetic_rooms(spark, sf):
    """Rooms that only objects name: their extent from those objects, numbered after the known ones. One row a room."""
    known = table(spark, sf, "region").select(F.concat(F.lit("room_"), F.col("r_regionkey").cast("string")).alias("room"))
    lost = items(spark, sf).join(known, "room", "left_anti").groupBy("room").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.round(F.avg("cx"), 6).alias("cx"), F.count(F.lit(1)).alias("objects"))
    n = known.agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy("room")) + F.col("n") - 1
    return lost.crossJoin(F.broadcast(n)).select("room", "x0", "x1", "cx", "objects", place.alias("place"))


@query(f"WITH {ITEMS} SELECT id, label, points FROM it WHERE active AND points > 0 AND points >= 10 AND (key_ = 'chair' OR contains(lower(room), 'room_3') OR starts_with(key_, 'water'))".replace("FROM it WHERE", "FROM (SELECT *, lower(replace(label, '_', ' ')) AS key_ FROM it) WHERE"))
def instance_search(spark, sf):
    """Active instances of ten points or more that match a comma list of terms: exactly, as a prefix, or in the room's name."""
    key = F.lower(F.replace("label", F.lit("_"), F.lit(" ")))
    hit = (key == "chair") | F.contains(F.lower("room"), F.lit("room_3")) | F.startswith(key, F.lit("water"))
    return items(spark, sf).where(F.col("active") & (F.col("points") > 0) & (F.col("points") >= 10) & hit).select("id", "label", "points")


@query(f"WITH {ITEMS} SELECT lower(replace(label,'_',' ')) AS base, count(*) AS total, count(*) FILTER (active) AS active, CAST(sum(points) AS BIGINT) AS points FROM it GROUP BY 1")
def class_totals(spark, sf):
    return items(spark, sf).groupBy(F.lower(F.replace("label", F.lit("_"), F.lit(" "))).alias("base")).agg(F.count(F.lit(1)).alias("total"), F.count_if("active").alias("active"), F.sum("points").alias("points"))


@query(f"WITH {ITEMS} SELECT count(*) AS instances, count(*) FILTER (active AND points > 0) AS active, count(DISTINCT label) AS labels, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, min(z0) AS z0, max(z1) AS z1 FROM it")
def viewer_metadata(spark, sf):
    bounds = [f(f"{a}{k}").alias(f"{a}{k}") for a in "xyz" for f, k in ((F.min, 0), (F.max, 1))]
    live = F.col("active") & (F.col("points") > 0)
    return items(spark, sf).agg(F.count(F.lit(1)).alias("instances"), F.count_if(live).alias("active"), F.count_distinct("label").alias("labels"), *bounds)


@query(f"""WITH {ITEMS}, ok AS (SELECT *, score >= 0.02 AS good FROM it) SELECT id AS old_id, CASE WHEN good THEN row_number() OVER (PARTITION BY good, label ORDER BY id) END AS number, CASE WHEN good THEN label || '_' || row_number() OVER (PARTITION BY good, label ORDER BY id) END AS name, CASE WHEN NOT good THEN 'mean_score_below_threshold' END AS reason FROM ok""")
def kept_names(spark, sf):
    """Instances by mean score: those kept get new names counted within their label, the others a reason."""
    good = F.col("score") >= 0.02
    number = F.row_number().over(Window.partitionBy(good, "label").orderBy("id")).cast("long")
    out = items(spark, sf).select("id", "label", good.alias("good"), number.alias("n"))
    return out.select(F.col("id").alias("old_id"), F.when(F.col("good"), F.col("n")).alias("number"), F.when(F.col("good"), F.concat_ws("_", "label", "n")).alias("name"), F.when(~F.col("good"), "mean_score_below_threshold").alias("reason"))


@query(f"WITH {ITEMS} SELECT id, CASE WHEN regexp_matches(t, '^(.*?)[_ ]+(\\d+)$') THEN t2 ELSE t3 END AS shown FROM (SELECT id, t, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_extract(t, '^(.*?)[_ ]+(\\d+)$', 1), '_+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || regexp_extract(t, '^(.*?)[_ ]+(\\d+)$', 2) AS t2, array_to_string(list_transform(string_split(trim(regexp_replace(t, '_+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS t3 FROM (SELECT id, replace(CASE WHEN id % 3 = 0 THEN label || '_' || id ELSE label || '-wide' END, '-', ' ') AS t FROM it))")
def display_labels(spark, sf):
    """Labels as shown: words with capitals, a number at the end kept apart."""
    raw = F.when(F.col("id") % 3 == 0, F.concat_ws("_", "label", "id")).otherwise(F.concat("label", F.lit("-wide")))
    return items(spark, sf).select("id", words.display_label(raw).alias("shown"))


EVID = """wv AS (SELECT l_suppkey % 200 + 1 AS id, l_linenumber AS li, sum(l_tax * 10 * l_discount * 10) AS w FROM lineitem WHERE l_suppkey % 11 > 0 GROUP BY 1, 2),
ev AS (SELECT id, ['door','chair','elevator','cup','unknown','whiteboard','table'][li] AS label, round(w / sum(w) OVER (PARTITION BY id), 9) AS score FROM wv),
sm AS (SELECT *, trim(regexp_replace(replace(lower(label), '_', ' '), '\\s+', ' ', 'g')) AS k2 FROM it WHERE id <= 201),
cd AS (SELECT e.id, e.label AS key, e.label, e.score, i.label AS before, height, wide, deep, area FROM ev e JOIN (SELECT ms.id, ms.label, height, wide, deep, area FROM ms WHERE id <= 201) i ON e.id = i.id)"""


@query(f"""WITH {ITEMS}, {EVID}, bd AS (SELECT *, {SHAPE_SQL} IS NOT NULL AS bad FROM cd), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rank, row_number() OVER (PARTITION BY id, bad ORDER BY score DESC, label) AS sound FROM bd),
tp AS (SELECT id, max(label) FILTER (rank = 1) AS raw, max(score) FILTER (rank = 1) AS rs, max(label) FILTER (NOT bad AND sound = 1) AS sl, max(score) FILTER (NOT bad AND sound = 1) AS ss, coalesce(max(score) FILTER (NOT bad AND sound = 2), 0) AS sec FROM rk GROUP BY 1),
ch AS (SELECT id, raw, coalesce(sl, raw) AS best, coalesce(ss, rs) AS score, coalesce(ss, rs) - sec AS margin FROM tp),
dc AS (SELECT sm.id, sm.label AS before, best, raw, ch.score, margin, best <> 'unknown' AND (ch.score < 0.17 OR margin < 0.004) AS doubt FROM sm LEFT JOIN ch USING (id)),
bl AS (SELECT *, CASE WHEN score IS NULL THEN 'no_evidence' WHEN doubt THEN NULL WHEN score < 0.175 THEN 'best_score_below_threshold' WHEN margin < 0.01 THEN 'margin_below_threshold' END AS blocked FROM dc)
SELECT id, before, CASE WHEN blocked IS NOT NULL THEN before WHEN doubt THEN 'unknown' ELSE best END AS label, round(score, 6) AS score, round(margin, 6) AS margin, blocked, best <> raw AS corrected FROM bl""")
def relabel_decision(spark, sf):
    """Labels of objects by their points' evidence: plausible candidates first, unknown where weak, blocked by thresholds."""
    li = table(spark, sf, "lineitem").where("l_suppkey % 11 > 0")
    w = li.groupBy((F.col("l_suppkey") % 200 + 1).alias("id"), F.col("l_linenumber").alias("li")).agg(F.sum(F.col("l_tax") * 10 * F.col("l_discount") * 10).alias("w"))
    names = F.array(*[F.lit(v) for v in ("door", "chair", "elevator", "cup", "unknown", "whiteboard", "table")])
    ev = w.select("id", F.element_at(names, F.col("li")).alias("label"), F.round(F.col("w") / F.sum("w").over(Window.partitionBy("id")), 9).alias("score"))
    out = objects.relabelled(ev, items(spark, sf).where("id <= 201"), "id", 0.175, 0.01, "unknown", 0.17, 0.004)
    return out.select("id", "before", "label", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "blocked", "corrected")


@query("SELECT p_partkey AS id, len(list_filter(string_split('door, Chair ,,whiteboard' , ','), lambda x: lower(trim(x)) = lower(trim(l)) AND trim(x) <> '')) > 0 AS candidate FROM (SELECT p_partkey, [' Door','chair','cup','whiteboard '][p_partkey % 4 + 1] AS l FROM part)")
def relabel_candidates(spark, sf):
    """Which labels a comma list asks for, whatever the case and blanks."""
    own = F.element_at(F.array(*[F.lit(v) for v in (" Door", "chair", "cup", "whiteboard ")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    asked = F.filter(F.transform(F.split(F.lit("door, Chair ,,whiteboard"), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_contains(asked, F.lower(F.trim(own))).alias("candidate"))


@query(f"""WITH {ITEMS}, nm AS (SELECT label || '_' || (id % 40) AS name, min(id) AS id FROM it WHERE active GROUP BY 1), ol AS (SELECT l_partkey AS a, l_suppkey AS b, CASE l_linenumber % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'on_top_of' ELSE 'inside' END AS relation FROM lineitem),
nn AS (SELECT id, label || '_' || (id % 40) AS name FROM it) SELECT DISTINCT s.id AS src, t.id AS dst, relation FROM ol JOIN nn a ON a.id = ol.a JOIN nn b ON b.id = ol.b JOIN nm s ON s.name = a.name JOIN nm t ON t.name = b.name WHERE relation <> 'inside'""")
def rewritten_edges(spark, sf):
    """Edges between names, rewritten to the first active object of each name; repeats and other relations go."""
    named = items(spark, sf).select("id", F.concat(F.col("label"), F.lit("_"), (F.col("id") % 40).cast("string")).alias("name"), "active")
    first = named.where("active").groupBy("name").agg(F.min("id").alias("first"))
    to = named.join(first, "name").select("id", "first")
    k = F.col("l_linenumber") % 3
    old = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(k == 0, "near").when(k == 1, "on_top_of").otherwise("inside").alias("relation")).where("relation <> 'inside'")
    return old.join(to.select(F.col("id").alias("a"), F.col("first").alias("src")), "a").join(to.select(F.col("id").alias("b"), F.col("first").alias("dst")), "b").select("src", "dst", "relation").distinct()


@query(f"WITH {ITEMS} SELECT printf('instance_%06d', id) AS node, room, label FROM it WHERE coalesce(active, true) AND points > 0")
def edited_graph_nodes(spark, sf):
    return items(spark, sf).where(F.coalesce("active", F.lit(True)) & (F.col("points") > 0)).select(F.format_string("instance_%06d", "id").alias("node"), "room", "label")


@query(f"WITH {ITEMS}, b AS (SELECT room, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM it WHERE id % 9 = 4 OR points > 48 GROUP BY room) SELECT a.room AS a, b.room AS b, round(sqrt(pow(greatest(a.x0-b.x1, b.x0-a.x1, 0),2) + pow(greatest(a.y0-b.y1, b.y0-a.y1, 0),2)),6) AS gap FROM b a JOIN b b ON a.room < b.room WHERE sqrt(pow(greatest(a.x0-b.x1, b.x0-a.x1, 0),2) + pow(greatest(a.y0-b.y1, b.y0-a.y1, 0),2)) <= 3")
def room_gaps(spark, sf):
    """Rooms whose extents, taken from what they hold, come within three metres."""
    e = items(spark, sf).where("id % 9 = 4 or points > 48").groupBy("room").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return relations.box_pairs(e, "room", 3.0).select(F.col("a_room").alias("a"), F.col("b_room").alias("b"), F.round("gap", 6).alias("gap"))
