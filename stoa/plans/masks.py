"""Queries over instance masks: suppliers are masks over parts (points), twenty parts an instance; embeddings are features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.operators import masks, metrics
from stoa.plans.registry import query
from stoa.session import scratch, table

# a mask is a stretch of parts around an instance's, of another length and shift for each supplier
MASKS = """mk AS (SELECT s_suppkey % 3 AS scene, s_suppkey AS mask_id, s_suppkey // 3 % 4 AS class, p_partkey AS point_id FROM supplier JOIN part ON p_partkey BETWEEN (s_suppkey // 20 * 20 + s_suppkey // 3 * 4 % 10 + s_suppkey % 4) * 20 + s_suppkey % 7 AND (s_suppkey // 20 * 20 + s_suppkey // 3 * 4 % 10 + s_suppkey % 4) * 20 + 10 + s_suppkey % 13),
gt AS (SELECT CAST(s AS BIGINT) AS scene, p_partkey AS point_id, CASE WHEN p_partkey // 20 % 5 < 4 THEN p_partkey // 20 % 4 END AS class, p_partkey // 20 AS instance FROM part, range(3) t(s)),
sc AS (SELECT s_suppkey % 3 AS scene, s_suppkey AS mask_id, s_suppkey * 37 % 1009 / 1009.0::DOUBLE AS score FROM supplier)"""
PAIRS = f"""{MASKS}, sz AS (SELECT scene, class, instance, count(*) AS size FROM gt WHERE class IS NOT NULL GROUP BY 1, 2, 3), pn AS (SELECT scene, mask_id, class, count(*) AS points FROM mk GROUP BY 1, 2, 3),
pr AS (SELECT scene, class, mask_id, instance, count(*) AS inter FROM mk JOIN gt USING (scene, point_id, class) GROUP BY 1, 2, 3, 4)"""


def _masks(spark, sf):
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part").select("p_partkey")
    k = F.col("s_suppkey")
    first = (F.floor(k / 20) * 20 + F.floor(k / 3) * 4 % 10 + k % 4) * 20
    spots = s.select((k % 3).alias("scene"), k.alias("mask_id"), (F.floor(k / 3) % 4).alias("class"), F.explode(F.sequence(first + k % 7, first + 10 + k % 13)).alias("point_id"))
    return spots.join(p, F.col("point_id") == F.col("p_partkey"), "left_semi")


def _truth(spark, sf):
    i = F.floor(F.col("p_partkey") / 20)
    return table(spark, sf, "part").select(F.explode(F.array(*[F.lit(s).cast("long") for s in range(3)])).alias("scene"), F.col("p_partkey").alias("point_id"), F.when(i % 5 < 4, i % 4).alias("class"), i.alias("instance"))


def _scores(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select((k % 3).alias("scene"), k.alias("mask_id"), (k * 37 % 1009 / 1009.0).alias("score"))


@query(f"WITH {PAIRS} SELECT scene, class, mask_id, instance, inter AS shared, size, points FROM pr JOIN sz USING (scene, class, instance) JOIN pn USING (scene, class, mask_id)")
def mask_intersections(spark, sf):
    return masks.intersections(_masks(spark, sf), _truth(spark, sf)).withColumnRenamed("both", "shared")


OVERLAPS = [0.5, 0.6, 0.7]
MATCHES = f"""{PAIRS}, ok AS (SELECT * FROM pn WHERE points >= 5), sh AS (SELECT pr.scene, pr.class, pr.mask_id, pr.instance, inter, size, inter / (size + points - inter) AS share FROM pr JOIN sz USING (scene, class, instance) JOIN ok ON ok.scene = pr.scene AND ok.mask_id = pr.mask_id),
vd AS (SELECT scene, mask_id, count(*) AS void FROM mk JOIN gt USING (scene, point_id) WHERE gt.class IS NULL GROUP BY 1, 2), tn AS (SELECT scene, mask_id, sum(inter) AS tiny FROM sh WHERE size < 5 GROUP BY 1, 2),
th AS (SELECT unnest({OVERLAPS}::DOUBLE[]) AS overlap),
hit AS (SELECT overlap, sh.class, sh.scene, instance, score, row_number() OVER (PARTITION BY overlap, sh.scene, instance ORDER BY score DESC) AS rn FROM sh JOIN sc USING (scene, mask_id), th WHERE share > overlap AND size >= 5),
fp AS (SELECT overlap, ok.class, score FROM ok JOIN sc USING (scene, mask_id) CROSS JOIN th LEFT JOIN vd USING (scene, mask_id) LEFT JOIN tn USING (scene, mask_id) WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.scene = ok.scene AND sh.mask_id = ok.mask_id AND share > overlap) AND (coalesce(void, 0) + coalesce(tiny, 0)) / points <= overlap),
yy AS (SELECT overlap, class, score, CAST(rn = 1 AS INT) AS hit FROM hit UNION ALL SELECT overlap, class, score, 0 FROM fp),
ls AS (SELECT overlap, class, count(*) AS lost FROM sz, th WHERE size >= 5 AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.overlap = th.overlap AND hit.scene = sz.scene AND hit.instance = sz.instance) GROUP BY 1, 2),
cu AS (SELECT *, sum(hit) OVER w AS tp, row_number() OVER w AS n FROM yy WINDOW w AS (PARTITION BY overlap, class ORDER BY score DESC, hit DESC ROWS UNBOUNDED PRECEDING)),
en AS (SELECT *, max(tp / n) OVER (PARTITION BY overlap, class ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM cu)"""


@query(f"""WITH {MATCHES}, ar AS (SELECT overlap, class, sum(hit) AS hits, sum(CASE WHEN hit = 1 THEN env END) AS area FROM en GROUP BY 1, 2), kc AS (SELECT overlap, class FROM ar UNION SELECT overlap, class FROM ls)
SELECT kc.overlap, kc.class, round(coalesce(area, 0) / (coalesce(hits, 0) + coalesce(lost, 0)), 6) AS ap FROM kc LEFT JOIN ar USING (overlap, class) LEFT JOIN ls USING (overlap, class) WHERE coalesce(hits, 0) + coalesce(lost, 0) > 0""")
def mask_average_precision(spark, sf):
    """Average precision of masks by class at three overlaps: greedy matching of masks to instances, then the envelope."""
    found = masks.matches(_masks(spark, sf), _scores(spark, sf), _truth(spark, sf), OVERLAPS, 5)
    return masks.average_precision(found, ["overlap", "class"]).select("overlap", "class", F.round("ap", 6).alias("ap"))


@query(f"""WITH {MATCHES}, ar AS (SELECT overlap, class, sum(hit) AS hits, sum(CASE WHEN hit = 1 THEN env END) AS area FROM en GROUP BY 1, 2), kc AS (SELECT overlap, class FROM ar UNION SELECT overlap, class FROM ls),
ap AS (SELECT kc.overlap, kc.class, coalesce(area, 0) / (coalesce(hits, 0) + coalesce(lost, 0)) AS ap FROM kc LEFT JOIN ar USING (overlap, class) LEFT JOIN ls USING (overlap, class) WHERE coalesce(hits, 0) + coalesce(lost, 0) > 0)
SELECT CASE WHEN class < 2 THEN 'head' ELSE 'tail' END AS subset, round(avg(ap), 6) AS map, round(avg(ap) FILTER (overlap = 0.5), 6) AS map50 FROM ap GROUP BY 1""")
def mask_mean_precision(spark, sf):
    """Means of the classes' average precision by subset of classes."""
    found = masks.matches(_masks(spark, sf), _scores(spark, sf), _truth(spark, sf), OVERLAPS, 5)
    ap = masks.average_precision(found, ["overlap", "class"])
    return ap.groupBy(F.when(F.col("class") < 2, "head").otherwise("tail").alias("subset")).agg(F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg(F.when(F.col("overlap") == 0.5, F.col("ap"))), 6).alias("map50"))


@query(f"""WITH {MATCHES}, ar AS (SELECT overlap, class, sum(hit) AS hits, sum(CASE WHEN hit = 1 THEN env END) AS area FROM en GROUP BY 1, 2), kc AS (SELECT overlap, class FROM ar UNION SELECT overlap, class FROM ls)
SELECT kc.overlap, kc.class, round(coalesce(area, 0) / (coalesce(hits, 0) + coalesce(lost, 0)), 6) AS ap FROM kc LEFT JOIN ar USING (overlap, class) LEFT JOIN ls USING (overlap, class) WHERE coalesce(hits, 0) + coalesce(lost, 0) > 0""")
def precision_over_runs(spark, sf):
    """Average precision from the saved states of two runs, the second over the last scene."""
    path = scratch(spark, "metric")
    own, told, real = _masks(spark, sf), _scores(spark, sf), _truth(spark, sf)
    for run, scenes in (("first", "scene < 2"), ("second", "scene = 2")):
        metrics.saved(metrics.matching_state(masks.matches(*[t.where(scenes) for t in (own, told, real)], OVERLAPS, 5)), path, run)
    return metrics.average_precisions(metrics.continued(spark, path)).select("overlap", "class", F.round("ap", 6).alias("ap"))


@query("""WITH p AS (SELECT CASE WHEN p_partkey // 20 % 5 < 4 THEN p_partkey // 20 % 4 END AS gt, (p_partkey // 20 % 4 + CASE WHEN p_partkey % 7 = s THEN 1 ELSE 0 END) % 4 AS pred FROM part, range(3) t(s)), k AS (SELECT * FROM p WHERE gt IS NOT NULL),
c AS (SELECT class, (SELECT count(*) FROM k WHERE gt = class AND pred = class) AS tp, (SELECT count(*) FROM k WHERE gt = class) AS g, (SELECT count(*) FROM k WHERE pred = class) AS q FROM range(4) t(class))
SELECT class, round(tp / (g + q - tp), 6) AS iou, round(CASE WHEN g > 0 THEN tp / g ELSE 0 END, 6) AS accuracy FROM c WHERE g + q > 0""")
def iou_over_runs(spark, sf):
    """Intersection over union and accuracy of classes from a run a scene; the last is saved twice, as after a failure."""
    path, real = scratch(spark, "metric"), _truth(spark, sf)
    for scene in (0, 1, 2, 2):
        labels = real.where(F.col("scene") == scene).select(F.col("class").alias("gt"), ((F.floor(F.col("point_id") / 20) % 4 + (F.col("point_id") % 7 == scene).cast("int")) % 4).alias("pred"))
        metrics.saved(metrics.confusion_state(labels), path, f"scene-{scene}")
    return metrics.class_scores(metrics.continued(spark, path)).select("class", F.round("iou", 6).alias("iou"), F.round("accuracy", 6).alias("accuracy"))


LOGITS = """lg AS (SELECT vec_id AS point_id, vec_id % 12 AS mask_id, [exp(CAST(embedding[1] AS DOUBLE)*4), exp(CAST(embedding[2] AS DOUBLE)*4), exp(CAST(embedding[3] AS DOUBLE)*4), exp(CAST(embedding[4] AS DOUBLE)*4)] AS e, CAST(embedding[5] AS DOUBLE)*3 AS m FROM embeddings)"""


def _logits(spark, sf):
    e = F.transform(F.slice("embedding", 1, 4), lambda x: F.exp(x.cast("double") * 4))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), (F.col("vec_id") % 12).alias("mask_id"), F.transform(e, lambda x: x / total).alias("p"), (F.col("embedding")[4].cast("double") * 3).alias("m"))


@query(f"""WITH {LOGITS}, s AS (SELECT mask_id, k, avg(e[k+1] / list_sum(e)) AS p FROM lg, range(4) t(k) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY round(p, 9) DESC, k) AS rn FROM s WHERE k <> 2)
SELECT mask_id, CAST(k AS INT) AS class, round(p, 6) AS score FROM r WHERE rn = 1""")
def mask_class_votes(spark, sf):
    """Each mask's class by the mean softmax of its points; ignored classes can't win."""
    p = _logits(spark, sf).select("mask_id", F.posexplode("p").alias("class", "p")).where("class <> 2")
    mean = p.groupBy("mask_id", "class").agg(F.avg("p").alias("s"))
    best = F.row_number().over(Window.partitionBy("mask_id").orderBy(F.desc(F.round("s", 9)), "class"))
    return mean.withColumn("rn", best).where("rn = 1").select("mask_id", "class", F.round("s", 6).alias("score"))


@query(f"WITH {LOGITS} SELECT mask_id, round(sum(CASE WHEN m > 0 THEN 1 / (1 + exp(-m)) ELSE 0 END) / (count(*) FILTER (m > 0) + 1e-6) * avg(e[1] / list_sum(e)), 6) AS confidence FROM lg GROUP BY 1")
def mask_confidence(spark, sf):
    """Mean sigmoid over a mask's own points, times its class probability."""
    on = F.col("m") > 0
    sure = F.sum(F.when(on, 1 / (1 + F.exp(-F.col("m")))).otherwise(0.0)) / (F.count_if(on) + 1e-6)
    return _logits(spark, sf).groupBy("mask_id").agg(F.round(sure * F.avg(F.col("p")[0]), 6).alias("confidence"))


@query("SELECT l_linenumber AS caption_id, count(*) AS n, round(sum(l_quantity), 6) AS total, round(avg(l_quantity), 6) AS mean, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1")
def caption_features(spark, sf):
    """Sums and means of the features of each caption's points."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("caption_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))


@query("WITH c AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) a, CAST(embedding[2] AS DOUBLE) b FROM embeddings) SELECT l_partkey AS point_id, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM lineitem JOIN c ON vec_id = l_suppkey GROUP BY 1")
def caption_means_to_points(spark, sf):
    """Each point's mean of the embeddings of the captions that cover it."""
    c = table(spark, sf, "embeddings").select(F.col("vec_id").alias("l_suppkey"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return table(spark, sf, "lineitem").join(c, "l_suppkey").groupBy(F.col("l_partkey").alias("point_id")).agg(F.round(F.avg("a"), 6).alias("a"), F.round(F.avg("b"), 6).alias("b"))


@query("""WITH p AS (SELECT label AS gt, (label + vec_id % 3) % 10 AS pred FROM embeddings WHERE label <> 9) SELECT CAST(k AS INT) AS class, count(*) FILTER (gt = k AND pred = k) AS common, count(*) FILTER (pred = k) AS predicted, count(*) FILTER (gt = k) AS truth FROM p, range(10) t(k) GROUP BY 1""")
def intersection_histogram(spark, sf):
    """Points of each class in prediction, truth and both; ignored truth takes no part."""
    p = table(spark, sf, "embeddings").where("label <> 9").select(F.col("label").alias("gt"), ((F.col("label") + F.col("vec_id") % 3) % 10).alias("pred"))
    sides = p.select(F.explode(F.array(F.struct(F.col("gt").alias("k"), F.lit(1).alias("g"), F.lit(0).alias("q")), F.struct(F.col("pred").alias("k"), F.lit(0).alias("g"), F.lit(1).alias("q")))).alias("s"), (F.col("gt") == F.col("pred")).cast("int").alias("same"))
    n = sides.groupBy(F.col("s.k").cast("int").alias("class")).agg(F.sum(F.col("s.g") * F.col("same")).alias("common"), F.sum("s.q").alias("predicted"), F.sum("s.g").alias("truth"))
    classes = spark.range(10).select(F.col("id").cast("int").alias("class"))
    return classes.join(n, "class", "left").na.fill(0)


@query("""WITH q AS (SELECT vec_id, CAST(k - 1 AS INT) AS class, CAST(embedding[k] AS DOUBLE) AS s FROM embeddings, range(1, 9) t(k)), r AS (SELECT *, label_, row_number() OVER (PARTITION BY label_ ORDER BY s DESC, vec_id, class) AS rank FROM (SELECT q.*, label AS label_ FROM q JOIN embeddings USING (vec_id))) SELECT label_ AS scene, rank, vec_id, class FROM r WHERE rank <= 10""")
def top_query_class_pairs(spark, sf):
    """Of each scene the ten best (query, class) pairs of all scores laid flat: the cap is the operator."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("scene"), "vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("class", "s"))
    rank = F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("s"), "vec_id", "class")).cast("long")
    return e.withColumn("rank", rank).where("rank <= 10").select("scene", "rank", "vec_id", "class")


@query("""WITH p AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id < 12), d AS (SELECT e.vec_id AS point_id, p.vec_id AS mask_id, list_sum(list_transform(range(1, 9), lambda k: CAST(e.embedding[k] AS DOUBLE) * CAST(p.embedding[k] AS DOUBLE))) AS s FROM embeddings e, p) SELECT mask_id, count(*) FILTER (s > 0) AS points, round(max(s), 6) AS top FROM d GROUP BY 1""")
def mask_logits(spark, sf):
    """Products of point features and mask embeddings, cut at zero. Masks are a dozen queries, kept as one array."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("v"))
    protos = e.where("vec_id < 12").agg(F.collect_list(F.struct(F.col("vec_id").alias("mask_id"), F.col("v").alias("w"))).alias("ws"))
    met = e.crossJoin(F.broadcast(protos)).select("v", F.explode("ws").alias("w"))  # twelve for each point: the queries asked
    dot = F.aggregate(F.zip_with("v", "w.w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return met.select("w.mask_id", dot.alias("s")).groupBy("mask_id").agg(F.count_if(F.col("s") > 0).alias("points"), F.round(F.max("s"), 6).alias("top"))


@query("""WITH n AS (SELECT vec_id, vec_id % 6 AS label, list_transform(range(1, 9), lambda k: CAST(embedding[k] AS DOUBLE)) AS v FROM embeddings), u AS (SELECT label, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS v FROM n),
m AS (SELECT label, list(a ORDER BY k) AS m FROM (SELECT label, k, avg(v[k]) AS a FROM u, range(1, 9) t(k) GROUP BY 1, 2) GROUP BY 1) SELECT label, round(m[1] / sqrt(list_sum(list_transform(m, lambda y: y * y))), 6) AS first, round(m[8] / sqrt(list_sum(list_transform(m, lambda y: y * y))), 6) AS last FROM m""")
def prompt_mean_embedding(spark, sf):
    """One direction a label: the mean of its prompts' directions, made a unit again."""
    v = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    norm = lambda c: F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    u = table(spark, sf, "embeddings").select((F.col("vec_id") % 6).alias("label"), v.alias("v")).withColumn("n", norm(F.col("v")))
    m = u.groupBy("label").agg(F.array(*[F.avg(F.col("v")[k] / F.col("n")) for k in range(8)]).alias("m")).withColumn("n", norm(F.col("m")))
    return m.select("label", F.round(F.col("m")[0] / F.col("n"), 6).alias("first"), F.round(F.col("m")[7] / F.col("n"), 6).alias("last"))


@query("""WITH x AS (SELECT vec_id, list_transform(range(1, 5), lambda k: CAST(embedding[k] AS DOUBLE) / greatest(0.05, 1e-6)) AS z FROM embeddings), m AS (SELECT vec_id, z, list_max(z) AS t FROM x), e AS (SELECT vec_id, list_transform(z, lambda v: exp(v - t)) AS e FROM m) SELECT vec_id, round(e[1] / list_sum(e), 6) AS p0, round(e[4] / list_sum(e), 6) AS p3, CAST(list_position(e, list_max(e)) - 1 AS INT) AS best FROM e""")
def softmax_at_temperature(spark, sf):
    """Softmax of logits over a temperature that is never below a millionth, and the largest."""
    z = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") / F.greatest(F.lit(0.05), F.lit(1e-6)))
    e = table(spark, sf, "embeddings").select("vec_id", z.alias("z")).withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.round(F.col("e")[0] / total, 6).alias("p0"), F.round(F.col("e")[3] / total, 6).alias("p3"), (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("best"))
