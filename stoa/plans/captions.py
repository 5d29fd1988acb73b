"""Queries over captions: benchmark items and document texts under the caption filters; words, names and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoa.functions import text as fn
from stoa.operators import sampling
from stoa.plans.registry import query
from stoa.session import table

RAW = r"rw AS (SELECT doc_id, text, n_chars % 7 AS points, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents)"


def captions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", (F.col("n_chars") % 7).alias("points"))


COUNTS = r"""wc AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS x FROM rw) GROUP BY 1, 2) GROUP BY 1),
ph AS (SELECT doc_id, max(n) AS refrain FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i+1], ' ')), list_transform(range(1, len(ws)-1), lambda i: array_to_string(ws[i:i+2], ' ')))) AS x FROM rw WHERE len(ws) >= 4) GROUP BY 1, 2) GROUP BY 1),
ps AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM rw), ru AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, x, g, count(*) AS n FROM (SELECT doc_id, x, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS g FROM ps) GROUP BY 1, 2, 3) GROUP BY 1)"""


@query(f"WITH {RAW}, {COUNTS} SELECT doc_id, len(ws) < 3 OR top / len(ws) <= 0.4 AS ok FROM rw LEFT JOIN wc USING (doc_id)")
def caption_varied(spark, sf):
    """Captions whose most frequent word is at most two fifths of them."""
    raw = captions(spark, sf).select("doc_id", fn.caption_words(F.col("text")).alias("raw"))
    return raw.select("doc_id", fn.word_repetition_ok(F.col("raw")).alias("ok"))


@query(f"WITH {RAW}, {COUNTS} SELECT doc_id, CAST(coalesce(run, 0) AS INT) AS longest, coalesce(run, 0) <= 3 AS ok FROM rw LEFT JOIN ru USING (doc_id)")
def caption_stutter(spark, sf):
    """The longest run of one word, and whether it is at most three."""
    runs = captions(spark, sf).select("doc_id", fn.longest_run(fn.caption_words(F.col("text"))).alias("longest"))
    return runs.select("doc_id", "longest", (F.col("longest") <= 3).alias("ok"))


@query(rf"""WITH {RAW}, {COUNTS}, fl AS (SELECT doc_id, trim(text) <> '' AS filled, len(list_filter(regexp_split_to_array(regexp_replace(text, '[:,]', ' ', 'g'), '\s+'), lambda x: x <> '')) BETWEEN 3 AND 50 AS long_enough,
length(regexp_replace(text, '\s', '', 'g')) > 0 AND length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / greatest(length(regexp_replace(text, '\s', '', 'g')), 1) >= 0.5 AS lettered, len(ws) < 3 OR top / len(ws) <= 0.4 AS varied, coalesce(run, 0) <= 3 AS no_stutter, len(ws) < 4 OR coalesce(refrain, 0) <= 3 AS no_refrain, points BETWEEN 1 AND 5 AS enough_points
FROM rw LEFT JOIN wc USING (doc_id) LEFT JOIN ph USING (doc_id) LEFT JOIN ru USING (doc_id)) SELECT *, filled AND long_enough AND lettered AND varied AND no_stutter AND no_refrain AND enough_points AS kept FROM fl""")
def caption_filter(spark, sf):
    """All caption filters, each with its verdict, and what they keep together."""
    made = captions(spark, sf).withColumns({"own": fn.words(F.col("text")), "raw": fn.caption_words(F.col("text"))})
    made = made.withColumn("pairs", F.concat(fn.phrases(F.col("raw"), 2), fn.phrases(F.col("raw"), 3)))
    flags = fn.caption_flags(*[F.col(c) for c in ("text", "own", "raw", "pairs", "points")], least_points=1, most_points=5)
    out = made.select("doc_id", *[c.alias(n) for n, c in flags.items()])
    kept = F.lit(True)
    for n in flags:
        kept = kept & F.col(n)
    return out.withColumn("kept", kept)


@query("""SELECT p_partkey AS caption_id, p_name || printf(', located at (%.2f, %.2f, %.2f)', x, y, z) AS caption FROM (SELECT l_partkey, round(avg(l_quantity), 6) + 1e-7 AS x, round(avg(l_discount), 6) + 1e-7 AS y, round(avg(l_tax), 6) + 1e-7 AS z FROM lineitem GROUP BY 1 HAVING count(*) > 1) JOIN part ON p_partkey = l_partkey""")
def caption_with_place(spark, sf):
    """Captions of more than one point with the place of their middle."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"), *[(F.round(F.avg(c), 6) + 1e-7).alias(a) for a, c in (("x", "l_quantity"), ("y", "l_discount"), ("z", "l_tax"))]).where("n > 1")
    at = F.format_string("%s, located at (%.2f, %.2f, %.2f)", "p_name", "x", "y", "z")
    return table(spark, sf, "part").select("p_partkey", "p_name").join(li, "p_partkey").select(F.col("p_partkey").alias("caption_id"), at.alias("caption"))


NAMES = ["the", "house", "city", "box", "und", "la"]


def _hide_sql() -> str:
    out = "text"
    for n in NAMES:
        end = n[:-1] + "ies" if n.endswith("y") else n + ("es" if n.endswith(("s", "x", "z", "ch", "sh")) else "s")
        out = rf"regexp_replace(regexp_replace({out}, '\b{end}\b', 'objects', 'gi'), '\b{n}\b', 'object', 'gi')"
    return out


@query(f"SELECT item_id, {_hide_sql()} AS caption FROM (SELECT item_id, text || ' Houses, cities and BOXES' AS text FROM benchmark)")
def class_names_hidden(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.concat("text", F.lit(" Houses, cities and BOXES")).alias("text"))
    return b.select("item_id", fn.anonymised(F.col("text"), NAMES).alias("caption"))


@query("""WITH k AS (SELECT p_partkey AS id, regexp_replace(trim(regexp_replace(lower(p_type || CASE WHEN p_partkey % 3 = 0 THEN 'ies ' || p_size WHEN p_partkey % 3 = 1 THEN '_boxes' ELSE '' END), '[_\\s-]+', ' ', 'g')), ' \\d+$', '') AS k FROM part),
f AS (SELECT id, k AS x FROM k UNION SELECT id, regexp_replace(k,'ies$','') || 'y' FROM k WHERE k LIKE '%ies' UNION SELECT id, regexp_replace(k,'es$','') FROM k WHERE k LIKE '%es' UNION SELECT id, regexp_replace(k,'s$','') FROM k WHERE k LIKE '%s')
SELECT id, string_agg(x, '|' ORDER BY x) AS variants FROM f GROUP BY id""")
def part_key_variants(spark, sf):
    """Keys of labels with their singular forms, over a whole table."""
    k = F.col("p_partkey") % 3
    label = F.concat("p_type", F.when(k == 0, F.concat(F.lit("ies "), F.col("p_size").cast("string"))).when(k == 1, "_boxes").otherwise(""))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(fn.class_key_variants(label), "|").alias("variants"))


@query("""WITH d AS (SELECT o_orderkey AS plan_id, o_custkey % 25 AS a, (o_custkey + 1 + CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END) % 25 AS b FROM orders)
SELECT plan_id, a AS src, b AS dst FROM d WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = a AND (a + 1) % 25 = b)""")
def order_broken_steps(spark, sf):
    """Moves that follow no edge, one move for each order, on the ring of nations."""
    from stoa.operators import graph

    o = table(spark, sf, "orders")
    a = F.col("o_custkey") % 25
    b = (F.col("o_custkey") + 1 + F.when(F.col("o_orderkey") % 5 == 0, 3).otherwise(0)) % 25
    steps = o.select(F.col("o_orderkey").alias("plan_id"), F.explode(F.array(F.struct(F.lit(0).alias("step"), a.alias("node")), F.struct(F.lit(1).alias("step"), b.alias("node")))).alias("s")).select("plan_id", "s.*")
    ring = table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst"))
    return graph.broken_steps(steps, ring).select("plan_id", F.col("before").alias("src"), F.col("node").alias("dst"))


@query("""SELECT doc_id, CASE WHEN NOT contains(text, 'status') AND NOT contains(text, 'the') THEN NULL ELSE length(text) END AS parsed FROM documents""")
def quick_prefilter(spark, sf):
    """Only texts that hold a marker are parsed at all."""
    marked = F.contains("text", F.lit("status")) | F.contains("text", F.lit("the"))
    return table(spark, sf, "documents").select("doc_id", F.when(marked, F.length("text").cast("long")).alias("parsed"))


@query("""WITH d AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, coalesce(epoch(ts) - epoch(before) > 300, false) AS stale FROM d""")
def time_stamps(spark, sf):
    """Stamps for file names, and events that come over five minutes after their user's last."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.timestamp_diff("MICROSECOND", before, F.col("ts")) / 1e6
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), F.coalesce(gap > 300, F.lit(False)).alias("stale"))


@query("""WITH b AS (SELECT p_partkey, p_type, md5(concat_ws(':', p_partkey, '21')) AS d FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY d, p_partkey) AS rn, count(*) OVER (PARTITION BY p_type) AS n FROM b)
SELECT p_partkey, p_type FROM r WHERE rn <= least(450, greatest(30, floor(600 / (2 * (SELECT count(DISTINCT p_type) FROM part)))))""")
def stratified_clamped(spark, sf):
    """Of each instance a share of the sample, never under 30 nor over 450 points: the caps are the operator."""
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    k = p.agg(F.count_distinct("p_type").alias("k")).first()["k"] or 1
    return sampling.hashed_top(p, ["p_type"], ["p_partkey"], 21, int(min(450, max(30, 600 // (2 * k)))))
