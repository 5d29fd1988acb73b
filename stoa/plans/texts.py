"""Queries over captions (benchmark and document texts), conversations, keys and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.functions import text as fn
from stoa.operators import sampling
from stoa.plans.registry import query
from stoa.session import table

BENCH_WORDS = "w AS (SELECT item_id, text, list_filter(regexp_split_to_array(regexp_replace(text, '[:,]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM benchmark)"


def _captions(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", "text", fn.words(F.col("text")).alias("ws"))


@query(f"WITH {BENCH_WORDS} SELECT item_id, CAST(len(ws) AS INT) AS n_words, len(ws) BETWEEN 3 AND 50 AS ok FROM w")
def caption_word_count(spark, sf):
    return _captions(spark, sf).select("item_id", F.size("ws").alias("n_words"), F.size("ws").between(3, 50).alias("ok"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(regexp_replace(text, '\s', '', 'g')),1) >= 0.85 AS ok FROM documents")
def caption_letter_ratio(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fn.letter_ratio_ok(F.col("text"), 0.85).alias("ok"))


@query(f"WITH {BENCH_WORDS}, c AS (SELECT item_id, x, count(*) n FROM (SELECT item_id, unnest(ws) x FROM w) GROUP BY 1,2) SELECT item_id, CAST(max(n) AS INT) AS top FROM c GROUP BY item_id")
def caption_word_repetition(spark, sf):
    return _captions(spark, sf).where(F.size("ws") > 0).select("item_id", fn.top_share(F.col("ws")).alias("top"))


@query(f"""WITH {BENCH_WORDS}, p AS (SELECT item_id, unnest(list_concat(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i+1], ' ')), list_transform(range(1, len(ws)-1), lambda i: array_to_string(ws[i:i+2], ' ')))) AS x FROM w WHERE len(ws) >= 4),
c AS (SELECT item_id, x, count(*) n FROM p GROUP BY 1,2) SELECT item_id, max(n) <= 1 AS ok FROM c GROUP BY item_id""")
def caption_phrase_repeats(spark, sf):
    """Phrases of two and three words, counted anywhere."""
    both = F.concat(fn.phrases(F.col("ws"), 2), fn.phrases(F.col("ws"), 3))
    return _captions(spark, sf).where(F.size("ws") >= 4).select("item_id", (fn.top_share(both) <= 1).alias("ok"))


@query("""WITH w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, event_type, g, count(*) n FROM w GROUP BY 1,2,3) SELECT user_id, CAST(max(n) AS INT) AS longest FROM r GROUP BY user_id""")
def longest_repeat(spark, sf):
    """Each user's longest run of one event type: gaps and islands by two row numbers."""
    order = [F.col("ts"), F.col("event_id")]
    g = F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*order))
    runs = table(spark, sf, "events").select("user_id", "event_type", g.alias("g")).groupBy("user_id", "event_type", "g").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").cast("int").alias("longest"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) rn FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, string_agg(role || ': ' || substr(text,1,100), ' / ' ORDER BY turn, text) AS context FROM r WHERE rn <= 6 GROUP BY conv_id""")
def last_turns(spark, sf):
    """The last six turns of each conversation, 100 characters of each."""
    own = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text"))
    c = table(spark, sf, "conversations").where("text is not null").withColumn("rn", F.row_number().over(own)).where("rn <= 6")
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda s: F.concat(s["role"], F.lit(": "), F.substring(s["text"], 1, 100)))
    return c.groupBy("conv_id").agg(F.array_join(said, " / ").alias("context"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) rn FROM conversations)
SELECT conv_id, role = 'assistant' AND contains(text, '?') AS asked FROM r WHERE rn = 1""")
def last_turn_asks(spark, sf):
    last = F.max_by(F.struct("role", "text"), F.struct("turn", "text")).alias("l")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(last).select("conv_id", ((F.col("l.role") == "assistant") & F.contains(F.col("l.text"), F.lit("?"))).alias("asked"))


@query("WITH d AS (SELECT DISTINCT text FROM documents) SELECT doc_id, dense_rank() OVER (ORDER BY md5(text)) - 1 AS inverse FROM documents")
def distinct_captions(spark, sf):
    """Each text's place among the distinct ones by hash; null is a text too, the last one."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(F.md5("text"), F.lit("~")).alias("h"))
    return d.join(sampling.dense_ranks(d, "h", "inverse"), "h").select("doc_id", "inverse")


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[_\s]+', ' ', 'g')) AS key, regexp_replace(regexp_replace(trim(p_type), '\s+', '_', 'g'), '[^\p{L}\p{N}_-]', '', 'g') AS safe FROM part")
def label_keys(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.label_key(F.col("p_name")).alias("key"), fn.safe_name(F.col("p_type")).alias("safe"))


@query("""WITH v(id, label) AS (VALUES (1,'Water-Dispensers 2'), (2,'batteries'), (3,'glass_boxes'), (4,'Chair'), (5,'desks 12')),
k AS (SELECT id, regexp_replace(trim(regexp_replace(lower(label), '[_\\s-]+', ' ', 'g')), ' \\d+$', '') AS k FROM v),
f AS (SELECT id, k AS x FROM k UNION SELECT id, regexp_replace(k,'ies$','') || 'y' FROM k WHERE k LIKE '%ies' UNION SELECT id, regexp_replace(k,'es$','') FROM k WHERE k LIKE '%es' UNION SELECT id, regexp_replace(k,'s$','') FROM k WHERE k LIKE '%s')
SELECT id, string_agg(x, '|' ORDER BY x) AS variants FROM f GROUP BY id""")
def class_key_variants(spark, sf):
    rows = [(1, "Water-Dispensers 2"), (2, "batteries"), (3, "glass_boxes"), (4, "Chair"), (5, "desks 12")]
    return spark.createDataFrame(rows, "id int, label string").select("id", F.array_join(fn.class_key_variants(F.col("label")), "|").alias("variants"))


@query("""SELECT s_suppkey, 'room_' || s_suppkey AS room, rank() OVER (ORDER BY s_suppkey) AS place FROM supplier""")
def natural_order(spark, sf):
    """Rooms by natural order of their names: digits by value. One row a room."""
    rooms = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("room_"), F.col("s_suppkey").cast("string")).alias("room"))
    return rooms.select("s_suppkey", "room", F.rank().over(Window.orderBy(fn.natural_key(F.col("room")))).cast("long").alias("place"))


@query("""SELECT event_id, round((value*0.7 + pi()) - 2*pi()*floor((value*0.7 + pi())/(2*pi())) - pi(), 6) AS angle FROM events""")
def angle_normalise(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(fn.angle(F.col("value") * 0.7), 6).alias("angle"))


@query("SELECT event_type, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY event_type".replace("max_by(event_id, (ts, event_id))", "arg_max(event_id, {'t': ts, 'i': event_id})"))
def latest_per_type(spark, sf):
    """Last value wins: the batch form of the latest-pose fold."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, round(CAST(json_extract(props, '$.k') AS BIGINT) / 1000.0, 6) AS degrees FROM events")
def telemetry_decode(spark, sf):
    p = F.from_json("props", "k long")
    return table(spark, sf, "events").select("event_id", p["k"].alias("k"), F.round(p["k"] / 1000.0, 6).alias("degrees"))


@query("""SELECT n_regionkey, sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey)) AS labels_sha256 FROM nation GROUP BY n_regionkey""")
def labels_hash(spark, sf):
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"])
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(names, "\n"), 256).alias("labels_sha256"))
