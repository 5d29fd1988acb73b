"""Queries over event streams: the events table played as files, users as robots and clients."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoa.plans.registry import query
from stoa.session import scratch, table
from stoa.sources import clouds
from stoa.streaming import dialogue, navigation
from stoa.streaming import events as ev
from stoa.streaming.replay import replayed


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 40).alias("user"), "event_type", "value", "props")


EV = "e AS (SELECT event_id, ts, user_id % 40 AS usr, event_type, value, props, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS k FROM events)"


def clocked(spark, sf, seconds):
    """The events, and a clock that strikes once ``seconds`` after the last of them."""
    e = events(spark, sf)
    return dialogue.with_clock(e, e.agg((F.max("ts") + F.make_interval(secs=F.lit(seconds))).alias("ts")), "user")


@query(f"""WITH {EV}, s AS (SELECT *, max(CASE WHEN event_type IN ('view', 'purchase') THEN k END) OVER (PARTITION BY usr ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e)
SELECT s.usr AS "user", s.event_id, CASE WHEN l.event_type = 'view' THEN CASE WHEN s.event_type = 'click' THEN 'saved ' ELSE 'dropped ' END || l.event_id ELSE 'no_pending' END AS answer FROM s LEFT JOIN e l ON l.usr = s.usr AND l.k = s.p WHERE s.event_type IN ('click', 'purchase')""")
def confirmed_texts(spark, sf):
    """Pending texts confirmed or rejected, as a stream."""
    return replayed(events(spark, sf), lambda s: dialogue.confirmations(s, "user", "view", "click", "purchase"), "confirm")


@query(f"""WITH {EV}, s AS (SELECT *, min(CASE WHEN event_type = 'click' THEN k END) OVER (PARTITION BY usr ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d FROM e)
SELECT s.usr AS "user", s.event_id, l.event_id AS drained_by, CAST(row_number() OVER (PARTITION BY s.usr, s.d ORDER BY s.k) - 1 AS INT) AS place FROM s JOIN e l ON l.usr = s.usr AND l.k = s.d WHERE s.event_type = 'error'""")
def drained_interrupts(spark, sf):
    return replayed(events(spark, sf), lambda s: dialogue.interrupts(s, "user", "error", "click"), "interrupts")


@query(f"""WITH {EV}, g AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY usr ORDER BY k) AS g FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY usr, g ORDER BY k) AS n FROM g WHERE event_type = 'error') SELECT usr AS "user", event_id FROM n WHERE n % 3 = 0""")
def retry_asks(spark, sf):
    return replayed(events(spark, sf), lambda s: dialogue.retries(s, "user", "error", "purchase"), "retries")


@query(f"""WITH {EV}, g AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN k ELSE 0 END) OVER (PARTITION BY usr ORDER BY k) AS g FROM e) SELECT g.usr AS "user", g.event_id, coalesce(l.event_id, -1) AS plan, CAST(CASE WHEN g.g = 0 THEN g.k - 1 ELSE g.k - g.g - 1 END AS INT) AS step FROM g LEFT JOIN e l ON l.usr = g.usr AND l.k = g.g""")
def plan_resets(spark, sf):
    return replayed(events(spark, sf), lambda s: dialogue.plan_steps(s, "user", "signup"), "resets")


@query(f"""WITH {EV}, s AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY usr ORDER BY k)) AS gap FROM e) SELECT usr AS "user", event_id, round(gap, 3) AS silent FROM s WHERE gap > 3600""")
def silent_links(spark, sf):
    out = replayed(events(spark, sf), lambda s: dialogue.stale_links(s, "user", 3600.0), "stale")
    return out.select("user", "event_id", F.round("silent", 3).alias("silent"))


@query(f"""WITH {EV}, s AS (SELECT *, epoch(lead(ts) OVER (PARTITION BY usr ORDER BY k)) - epoch(ts) AS gap FROM e) SELECT usr AS "user", event_id, round(epoch(ts), 3) AS heard FROM s WHERE gap > 3600 OR gap IS NULL""")
def silences_reported(spark, sf):
    """The last event before each silence of an hour, also of those who are never heard of again; the stream comes in four batches."""
    out = replayed(clocked(spark, sf, 10_000), lambda s: dialogue.silences(s, "user", 3600.0), "silences", batches=4)
    return out.select("user", "event_id", F.round("heard", 3).alias("heard"))


@query(f"""WITH RECURSIVE {EV}, f AS (SELECT usr, 0::BIGINT AS k, -1::BIGINT AS move, 0::DOUBLE AS began, 0::DOUBLE AS heard, -1::BIGINT AS o1, '' AS w1, -1::BIGINT AS o2, '' AS w2 FROM (SELECT DISTINCT usr FROM e) UNION ALL
SELECT usr, k, CASE WHEN st THEN event_id WHEN mv >= 0 AND dn THEN -1 ELSE mv END, CASE WHEN st THEN now ELSE began END, CASE WHEN st OR (mv >= 0 AND dn) OR pg THEN now ELSE heard END, CASE WHEN mv <> move THEN move ELSE -1 END, CASE WHEN heard + 40000 <= began + 90000 THEN 'no_progress' ELSE 'timeout' END, CASE WHEN mv >= 0 AND (st OR dn) THEN mv ELSE -1 END, CASE WHEN st THEN 'replaced' ELSE 'reached' END
FROM (SELECT f.usr, e.k, e.event_id, epoch(e.ts) AS now, f.move, f.began, f.heard, CASE WHEN f.move >= 0 AND (epoch(e.ts) - f.heard > 40000 OR epoch(e.ts) - f.began > 90000) THEN -1 ELSE f.move END AS mv, e.event_type = 'signup' AS st, e.event_type = 'view' AS pg, e.event_type = 'purchase' AS dn FROM f JOIN e ON e.usr = f.usr AND e.k = f.k + 1))
SELECT usr AS "user", o1 AS event_id, w1 AS outcome FROM f WHERE o1 >= 0 UNION ALL SELECT usr, o2, w2 FROM f WHERE o2 >= 0
UNION ALL SELECT usr, move, CASE WHEN heard + 40000 <= began + 90000 THEN 'no_progress' ELSE 'timeout' END FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY k DESC) AS back FROM f) WHERE back = 1 AND move >= 0""")
def move_outcomes(spark, sf):
    """How each started move ends: reached, without progress, out of time, or replaced. After the last event a clock goes on, so that moves left open end too."""
    return replayed(clocked(spark, sf, 100_000), lambda s: dialogue.outcomes(s, "user", "signup", "view", "purchase", 40000.0, 90000.0), "moves")


@query(f"""WITH RECURSIVE {EV}, f AS (SELECT usr, 0::BIGINT AS k, NULL::VARCHAR AS text, 0::DOUBLE AS at, NULL::TIMESTAMP AS kept FROM (SELECT DISTINCT usr FROM e) UNION ALL
SELECT f.usr, e.k, CASE WHEN n THEN e.event_type ELSE f.text END, CASE WHEN n THEN epoch(e.ts) ELSE f.at END, CASE WHEN n THEN e.ts END FROM (SELECT f.*, e.ts AS ts2, e.event_type, e.k AS k2, f.text IS DISTINCT FROM e.event_type OR epoch(e.ts) - f.at > 20000 AS n FROM f JOIN e ON e.usr = f.usr AND e.k = f.k + 1) f JOIN e ON e.usr = f.usr AND e.k = f.k2)
SELECT usr AS robot_id, kept AS ts, text FROM f WHERE kept IS NOT NULL""")
def deduped_questions(spark, sf):
    """Repeats of the last kept text within a window are dropped and don't refresh it."""
    rows = events(spark, sf).select(F.col("user").alias("robot_id"), "ts", F.col("event_type").alias("text"))
    out = replayed(rows, lambda s: ev.without_repeats(s, seconds=20000.0), "questions")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""WITH {EV}, c AS (SELECT *, event_type <> 'error' AND event_type <> 'click' AS ok FROM e), g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY usr ORDER BY k) AS g FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY usr, g ORDER BY k) AS n FROM g WHERE NOT ok) SELECT usr AS iface, ts, 3 AS failures FROM n WHERE n % 3 = 0""")
def watchdog_resets(spark, sf):
    """Resets of a link at every third failure in a row."""
    rows = events(spark, sf).select(F.col("user").alias("iface"), "ts", (~F.col("event_type").isin("error", "click")).alias("ok"))
    return replayed(rows, lambda s: ev.watchdog(s, cooldown=0.0), "watchdog").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'move' ELSE 'status' END AS command, '0100' || (event_id % 7) AS code FROM events WHERE event_id % 5 > 0""")
def message_frames(spark, sf):
    """Framed JSON messages, two a payload, malformed ones left out; the misspelt key counts."""
    k = F.col("event_id")
    name = F.when(k % 2 == 0, "command").otherwise("commanWd")
    good = F.format_string('{"%s": "%s", "code": "0100%d"}', name, F.when(k % 3 == 0, "move").otherwise("status"), k % 7)
    lines = table(spark, sf, "events").select("event_id", F.concat(F.when(k % 5 == 0, '{"command": ').otherwise(good), F.lit("\n\n")).alias("value"))
    return replayed(lines, ev.frames, "frames").select("event_id", "command", "code")


@query("""SELECT user_id % 40 AS "user", arg_max(event_id, {'t': ts, 'i': event_id}) AS event_id FROM events GROUP BY 1""")
def coalesced_updates(spark, sf):
    """Only the newest state of each client goes out, however many came."""
    newest = F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")
    return events(spark, sf).groupBy("user").agg(newest)


@query("SELECT event_id, event_type FROM events")
def mailbox_messages(spark, sf):
    """Messages taken once: a second run over the same checkpoints finds nothing new."""
    rows = table(spark, sf, "events").select("event_id", "event_type")
    return replayed(rows, lambda s: s, "mailbox", runs=2)


@query("SELECT a.event_id // 2 AS audio_id, a.ts AS asked_at, b.ts AS done_at FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0 AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 10000000 SECOND")
def answered_requests(spark, sf):
    """Requests joined to their end messages, stream to stream."""
    rows = events(spark, sf).select((F.floor(F.col("event_id") / 2)).alias("audio_id"), "ts", (F.col("event_id") % 2 == 0).alias("asks"))
    out = replayed(rows, lambda s: navigation.answered(s.where("asks").select("audio_id", "ts"), s.where("not asks").select("audio_id", "ts"), seconds=10_000_000), "answers")
    return out.select("audio_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("asked_at", "done_at")])


@query()
def navigation_states(spark, sf):
    """Each robot's navigation state after each notification."""
    k = F.col("event_id")
    codes = F.array(*[F.lit(c) for c in ("01101", "01001", "01002", "01001", "01002", "01102", "01005", "02003")])
    rows = events(spark, sf).select(
        F.concat(F.lit("robot"), F.col("user").cast("string")).alias("robot_id"), "ts", F.element_at(codes, (k % 8 + 1).cast("int")).alias("code"),
        F.concat(F.lit("m"), (k % 4).cast("string")).alias("target"), F.array(*[F.lit(f"m{i}") for i in range(4)]).alias("markers"),
    )
    return replayed(rows, navigation.navigation, "navigation")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS point_id, CAST(p_partkey / 4 AS FLOAT) AS x, CAST(p_size AS FLOAT) AS y, p_partkey % 256 AS r FROM part")
def ply_round_trip(spark, sf):
    """A cloud written as a binary file of vertices and read back by blocks."""
    clouds.register(spark)
    path = scratch(spark, "cloud") + ".ply"
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select((k / 4).cast("float").alias("x"), F.col("p_size").cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"), (k % 256).cast("int").alias("r"), F.lit(1).alias("g"), F.lit(2).alias("b"))
    p.orderBy("x").coalesce(1).write.format("ply").mode("append").save(path)  # one file's order; bodies of more parts are joined by the commit
    read = spark.read.format("ply").option("block", "1000").load(path)
    return read.select(F.col("point_id").cast("long").alias("point_id"), "x", "y", F.col("red").cast("long").alias("r"))
