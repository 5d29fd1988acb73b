"""Queries over robot plans: each order's line items are the lines of a plan, nations the places of a building."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoa.functions import plans as fn
from stoa.operators import graph
from stoa.plans.registry import query
from stoa.session import table

LINE = """CASE l_partkey % 29 WHEN 0 THEN 'pass()' WHEN 1 THEN 'show("' || n_name || '")' WHEN 2 THEN 'nav( )' WHEN 3 THEN 'speak("Hello, there?")' WHEN 4 THEN 'grasp(''cup_' || (l_suppkey % 7) || ''')'
 WHEN 5 THEN 'REASON: it is near' WHEN 6 THEN 'nav(nowhere, now)' WHEN 7 THEN ' Nav ( ''' || lower(n_name) || ''' , fast ) ' WHEN 8 THEN 'nav, ' || n_name WHEN 9 THEN 'arm, lift, slowly' WHEN 10 THEN '' ELSE 'nav("' || n_name || '")' END"""
TEXTS = f"""texts AS (SELECT l_orderkey AS plan_id, string_agg({LINE}, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 25 GROUP BY 1)"""
LINES = f"""{TEXTS}, ln AS (SELECT plan_id, k, trim(x) AS line FROM (SELECT plan_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM texts) WHERE trim(x) <> '')"""
CALLS = LINES + r""", raw AS (SELECT plan_id, k, lower(regexp_extract(line, '^\s*(\w+)\s*\(\s*(.*?)\s*\)\s*$', 1)) AS tool, regexp_extract(line, '^\s*(\w+)\s*\(\s*(.*?)\s*\)\s*$', 2) AS inside FROM ln WHERE regexp_matches(line, '^\s*(\w+)\s*\(\s*(.*?)\s*\)\s*$')),
cl AS (SELECT plan_id, k, tool, CASE WHEN regexp_extract(inside, '"([^"]+)"', 1) <> '' THEN trim(regexp_extract(inside, '"([^"]+)"', 1)) WHEN regexp_extract(inside, '''([^'']+)''', 1) <> '' THEN trim(regexp_extract(inside, '''([^'']+)''', 1)) ELSE trim(split_part(inside, ',', 1)) END AS arg FROM raw),
er AS (SELECT plan_id, arg_min(e, k) AS fault FROM (SELECT plan_id, k, CASE WHEN tool = 'show' THEN 'show() is not allowed in CV mode.' WHEN tool = 'pass' THEN 'pass() is not allowed in CV mode; use nav() only.' WHEN tool IN ('nav', 'grasp') AND arg = '' THEN 'Missing argument for ' || tool || '()' END AS e FROM cl) WHERE e IS NOT NULL GROUP BY 1),
ag AS (SELECT plan_id, list(arg ORDER BY k) FILTER (tool = 'nav') AS stops, list(arg ORDER BY k) FILTER (tool = 'grasp') AS grasps, count(*) FILTER (tool IN ('grasp', 'speak', 'vqa', 'face', 'greet', 'place')) AS talk FROM cl GROUP BY 1),
pr AS (SELECT plan_id, coalesce(stops, []) AS stops, coalesce(grasps, []) AS grasps, coalesce(talk, 0) > 0 AS talks, coalesce(fault, CASE WHEN coalesce(len(stops), 0) = 0 AND coalesce(talk, 0) = 0 THEN 'Missing nav()' END) AS error FROM texts LEFT JOIN ag USING (plan_id) LEFT JOIN er USING (plan_id))"""


def texts(spark, sf):
    li, n = table(spark, sf, "lineitem"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = li.join(n, F.col("l_suppkey") % 25 == F.col("n_nationkey"))
    name, k = F.col("n_name"), F.col("l_partkey") % 29
    said = {
        0: F.lit("pass()"), 1: F.concat(F.lit('show("'), name, F.lit('")')), 2: F.lit("nav( )"), 3: F.lit('speak("Hello, there?")'),
        4: F.concat(F.lit("grasp('cup_"), (F.col("l_suppkey") % 7).cast("string"), F.lit("')")), 5: F.lit("REASON: it is near"), 6: F.lit("nav(nowhere, now)"),
        7: F.concat(F.lit(" Nav ( '"), F.lower(name), F.lit("' , fast ) ")), 8: F.concat(F.lit("nav, "), name), 9: F.lit("arm, lift, slowly"), 10: F.lit(""),
    }
    line = F.coalesce(*[F.when(k == v, x) for v, x in said.items()], F.concat(F.lit('nav("'), name, F.lit('")')))
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("line"))))  # one order's lines
    return rows.groupBy(F.col("l_orderkey").alias("plan_id")).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


@query(f"WITH {CALLS} SELECT plan_id, array_to_string(stops, '>') AS stops, array_to_string(grasps, ',') AS grasps, talks, error FROM pr")
def plan_parse_calls(spark, sf):
    """Plans of tool calls: places in order, objects to grasp, whether it does anything else, and the first error."""
    p = texts(spark, sf).select("plan_id", fn.parsed(F.col("text")).alias("p"))
    return p.select("plan_id", F.array_join("p.stops", ">").alias("stops"), F.array_join("p.grasps", ",").alias("grasps"), "p.talks", "p.error")


@query(LINES.join(["WITH ", r" SELECT plan_id, array_to_string(list(lower(trim(split_part(line, ',', 1))) || '=' || trim(substr(line, strpos(line, ',') + 1)) ORDER BY k), '|') AS steps FROM ln WHERE contains(line, ',') AND lower(trim(split_part(line, ',', 1))) IN ('nav', 'arm') AND trim(substr(line, strpos(line, ',') + 1)) <> '' GROUP BY 1"]))
def plan_parse_commas(spark, sf):
    steps = texts(spark, sf).select("plan_id", fn.comma_steps(F.col("text")).alias("s")).where(F.size("s") > 0)
    return steps.select("plan_id", F.array_join(F.transform("s", lambda s: F.concat_ws("=", s["action"], s["rest"])), "|").alias("steps"))


@query(LINES.join(["WITH ", r""" SELECT plan_id, array_to_string(list(regexp_extract(line, '^(\w+)\((.*)\)', 1) || '=' || coalesce(nullif(replace(replace(trim(regexp_extract(line, '^(\w+)\((.*)\)', 2)), '''', ''), '"', ''), ''), '-') ORDER BY k), '|') AS steps FROM ln WHERE regexp_matches(line, '^(\w+)\((.*)\)') GROUP BY 1"""]))
def plan_parse_actions(spark, sf):
    steps = texts(spark, sf).select("plan_id", fn.action_steps(F.col("text")).alias("s")).where(F.size("s") > 0)
    return steps.select("plan_id", F.array_join(F.transform("s", lambda s: F.concat(s["action"], F.lit("="), F.coalesce(s["args"], F.lit("-")))), "|").alias("steps"))


# places: a ring of nations with a gap before every tenth, short cuts from every fifth, and the last one on its own
MAP = """pl AS (SELECT n_nationkey AS i, n_name AS node, CASE WHEN n_nationkey % 3 > 0 THEN 'O' ELSE 'S' END AS marker FROM nation),
st AS (SELECT i, (i + 1) % 25 AS j, 0 AS place FROM pl WHERE i % 10 <> 9 UNION ALL SELECT i, (i + 24) % 25, 1 FROM pl WHERE i % 10 <> 0 UNION ALL SELECT i, (i + 7) % 25, 2 FROM pl WHERE i % 5 = 0 UNION ALL SELECT i, (i + 4) % 25, 3 FROM pl WHERE i % 4 = 1),
ed AS (SELECT a.node AS src, b.node AS dst, place FROM st JOIN pl a ON a.i = st.i JOIN pl b ON b.i = st.j WHERE st.i <> 24 AND st.j <> 24)"""


def places(spark, sf):
    i = F.col("n_nationkey")
    return table(spark, sf, "nation").select(i.alias("i"), F.col("n_name").alias("node"), F.when(i % 3 > 0, "O").otherwise("S").alias("marker"))


def ways(spark, sf):
    p = places(spark, sf)
    step = lambda d, place, keep: p.where(keep).select("i", ((F.col("i") + d) % 25).alias("j"), F.lit(place).alias("place"))
    st = step(1, 0, "i % 10 <> 9").unionByName(step(24, 1, "i % 10 <> 0")).unionByName(step(7, 2, "i % 5 = 0")).unionByName(step(4, 3, "i % 4 = 1"))
    name = lambda key, alias: p.select(F.col("i").alias(key), F.col("node").alias(alias))
    st = st.where("i <> 24 and j <> 24")
    return st.join(name("i", "src"), "i").join(name("j", "dst"), "j").select("src", "dst", "place")


REACH = f"""{MAP}, o(start, node, hops) AS (SELECT node, node, 0 FROM pl UNION SELECT start, dst, hops + 1 FROM o JOIN ed ON src = o.node JOIN pl ON pl.node = o.node WHERE hops < 25 AND (o.node = start OR marker = 'O')),
a(start, node, hops) AS (SELECT node, node, 0 FROM pl UNION SELECT start, dst, hops + 1 FROM a JOIN ed ON src = node WHERE hops < 25),
ro AS (SELECT start, node, min(hops) AS hops FROM o GROUP BY 1, 2), ra AS (SELECT start, node, min(hops) AS hops FROM a GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {REACH} SELECT start, node, CAST(ra.hops AS INT) AS hops, CAST(ro.hops AS INT) AS marked_hops FROM ra LEFT JOIN ro USING (start, node)")
def shortest_hops(spark, sf):
    """From each place to each other within reach: hops, and hops through marked places only."""
    p, e = places(spark, sf), ways(spark, sf)
    starts = p.select(F.col("node").alias("start"))
    found = graph.both_paths(e, starts, p.where("marker = 'O'").select("node"))
    return found.select("start", "node", F.size("path").alias("hops"), F.when(F.col("bound_path").isNotNull(), F.size("bound_path")).alias("marked_hops"))


@query(f"""WITH RECURSIVE {CALLS}, {REACH}, sn AS (SELECT pr.*, coalesce(lower(n_name), 'attic') AS said, n_name AS here FROM pr LEFT JOIN nation ON n_nationkey = plan_id % 27),
lg AS (SELECT plan_id, here, leg, stop, node AS name FROM (SELECT plan_id, here, unnest(stops) AS stop, generate_subscripts(stops, 1) AS leg FROM sn) LEFT JOIN pl ON lower(trim(stop)) = lower(node)),
og AS (SELECT *, CASE WHEN leg = 1 THEN here ELSE lag(name) OVER (PARTITION BY plan_id ORDER BY leg) END AS origin FROM lg),
ft AS (SELECT og.plan_id, leg, name, CASE WHEN name IS NULL THEN 'Node does not exist: ' || stop WHEN ra.hops IS NULL THEN 'No path found for segment ' || leg END AS fault, coalesce(ro.hops, ra.hops) AS hops, CASE WHEN ro.hops IS NULL THEN 'fallback' ELSE 'o_only' END AS kind FROM og LEFT JOIN ra ON ra.start = origin AND ra.node = name LEFT JOIN ro ON ro.start = origin AND ro.node = name),
fl AS (SELECT plan_id, arg_min(fault, leg) FILTER (fault IS NOT NULL) AS fault, arg_max(name, leg) AS last, sum(hops) AS hops, array_to_string(list(kind ORDER BY leg), ',') AS kinds FROM ft GROUP BY 1),
ls AS (SELECT plan_id, arg_min(g, i) AS lost FROM (SELECT plan_id, unnest(grasps) AS g, generate_subscripts(grasps, 1) AS i FROM sn) WHERE g NOT IN (SELECT 'cup_' || r_regionkey FROM region) GROUP BY 1),
rs AS (SELECT sn.plan_id, here, last, hops, kinds, coalesce(error, CASE WHEN here IS NULL THEN 'Start node does not exist: ' || said END, CASE WHEN len(stops) = 0 AND lost IS NOT NULL THEN 'Object not present in scene graph: ' || lost END, fault) AS reason FROM sn LEFT JOIN fl USING (plan_id) LEFT JOIN ls USING (plan_id))
SELECT plan_id, CASE WHEN reason IS NULL THEN 'VALID' ELSE 'INVALID' END AS status, reason, CASE WHEN reason IS NULL THEN coalesce(last, here) END AS destination, CAST(CASE WHEN reason IS NULL THEN coalesce(hops, 0) END AS INT) AS hops, CASE WHEN reason IS NULL THEN coalesce(kinds, '') END AS kinds FROM rs""")
def plan_validate(spark, sf):
    """Plans checked from start to end on the map: grammar, names, objects, then a way for every leg."""
    n = table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    told = texts(spark, sf).select("plan_id", fn.parsed(F.col("text")).alias("p")).join(n, F.col("plan_id") % 27 == F.col("n_nationkey"), "left")
    plans = told.select("plan_id", F.coalesce("name", F.lit("attic")).alias("start"), "p.*")
    cups = table(spark, sf, "region").select(F.concat(F.lit("cup_"), F.col("r_regionkey").cast("string")).alias("object"))
    done = graph.validated_plans(plans, places(spark, sf).select("node", "marker"), ways(spark, sf), cups)
    return done.select("plan_id", "status", "reason", "destination", F.size("path").alias("hops"), F.array_join("kinds", ",").alias("kinds")).withColumn("hops", F.when(F.col("status") == "VALID", F.col("hops")))


@query(r"""SELECT doc_id, coalesce(trim(regexp_replace(replace(replace(replace(translate(text || ' ‘a’ “b” —…', '‘’“” ', '''''"" '), '—', ' - '), '–', ' - '), '…', '...'), '\s+', ' ', 'g')), '') AS said FROM documents""")
def speech_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fn.spoken(F.concat("text", F.lit(" ‘a’ “b” —…"))).alias("said"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS rn FROM conversations)
SELECT conv_id, role = 'assistant' AND len(list_filter(string_split('note' || chr(10) || 'speak("' || coalesce(text, '') || '")', chr(10)), lambda x: starts_with(trim(x), 'speak(') AND contains(x, '?'))) > 0 AS asked FROM c WHERE rn = 1""")
def last_turn_speaks_a_question(spark, sf):
    """Whether the last turn is the assistant's and a line of it speaks a question."""
    c = table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), F.struct("turn", "text")).alias("l"))
    said = F.concat(F.lit('note\nspeak("'), F.coalesce("l.text", F.lit("")), F.lit('")'))
    asks = F.exists(F.split(said, "\n"), lambda x: F.startswith(F.trim(x), F.lit("speak(")) & F.contains(x, F.lit("?")))
    return last.select("conv_id", ((F.col("l.role") == "assistant") & asks).alias("asked"))
