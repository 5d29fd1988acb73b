"""Queries of label evidence and metrics: line items vote for suppliers (labels) of parts (points)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.operators import masks, votes
from stoa.plans.registry import query
from stoa.session import table

W = "greatest(0, least(l_discount*8, 1)) * greatest(0.01, least(l_tax*10, 1))"
SUMS = f"s AS (SELECT l_partkey AS point_id, l_suppkey AS label, sum({W}) w FROM lineitem GROUP BY 1,2)"
BEST = f"{SUMS}, b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(w,9) DESC, label) rn FROM s)"


def _sums(spark, sf):
    weight = votes.vote_weight(F.col("l_discount") * 8, F.col("l_tax") * 10)
    return votes.vote_sums(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", weight)


@query(f"WITH {SUMS} SELECT point_id, label, round(w,6) w FROM s")
def weighted_votes(spark, sf):
    return _sums(spark, sf).select("point_id", "label", F.round("w", 6).alias("w"))


@query(f"WITH {BEST} SELECT p_partkey AS point_id, coalesce(label, -1) AS label, round(coalesce(w,0),6) AS score FROM part LEFT JOIN b ON point_id = p_partkey AND rn = 1")
def argmax_label(spark, sf):
    """Points without a vote get -1 and score 0."""
    best = votes.best_label(_sums(spark, sf))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"))
    return p.join(best, "point_id", "left").select("point_id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"), F.round(F.coalesce("w", F.lit(0.0)), 6).alias("score"))


@query(f"WITH {BEST} SELECT label, count(*) AS n FROM b WHERE rn = 1 GROUP BY label")
def label_histogram(spark, sf):
    return votes.best_label(_sums(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SUMS}, r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(w,9) DESC, label) AS rank FROM s)
SELECT point_id, rank, label FROM r WHERE rank <= 3""")
def top_label_candidates(spark, sf):
    return votes.ranked(_sums(spark, sf), ["point_id"], [F.desc(F.round("w", 9)), F.col("label")], 3).select("point_id", "rank", "label")


@query("""WITH b AS (SELECT l_suppkey AS instance, least(255, CAST(floor(l_discount*10*255) AS BIGINT)) AS bin, count(*) n FROM lineitem GROUP BY 1,2),
c AS (SELECT instance, bin, sum(n) OVER (PARTITION BY instance ORDER BY bin DESC) AS above, ceil(sum(n) OVER (PARTITION BY instance) * 0.3) AS target FROM b)
SELECT instance, round(max(bin)/255.0, 6) AS threshold FROM c WHERE above >= target GROUP BY instance""")
def reliability_thresholds(spark, sf):
    t = votes.reliability_threshold(table(spark, sf, "lineitem"), "l_suppkey", F.col("l_discount") * 10, 0.3)
    return t.select("instance", F.round("threshold", 6).alias("threshold"))


SOFT = """e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) a, CAST(embedding[2] AS DOUBLE) b, CAST(embedding[3] AS DOUBLE) c FROM embeddings),
x AS (SELECT label, exp(a/0.1) a, exp(b/0.1) b, exp(c/0.1) c FROM e)"""


@query(f"WITH {SOFT} SELECT label AS instance, round(sum(a/(a+b+c)),6) e0, round(sum(b/(a+b+c)),6) e1, round(sum(c/(a+b+c)),6) e2, count(*) n FROM x GROUP BY label")
def object_label_evidence(spark, sf):
    """Softmax of three logits at a temperature, summed by instance."""
    logits = F.transform(F.slice("embedding", 1, 3), lambda v: F.exp(v.cast("double") / 0.1))
    e = table(spark, sf, "embeddings").select("label", logits.alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    e = e.select("label", *[(F.col("x")[k] / total).alias(f"p{k}") for k in range(3)])
    return e.groupBy(F.col("label").alias("instance")).agg(*[F.round(F.sum(f"p{k}"), 6).alias(f"e{k}") for k in range(3)], F.count(F.lit(1)).alias("n"))


INSTANCES = f"""{BEST}, i AS (SELECT label AS instance_id, count(*) points, avg(w) mean_score FROM b WHERE rn=1 GROUP BY label)"""


def instances(spark, sf):
    return votes.best_label(_sums(spark, sf)).groupBy(F.col("label").alias("instance_id")).agg(F.count(F.lit(1)).alias("points"), F.avg("w").alias("mean_score"))


@query(f"""WITH {INSTANCES} SELECT instance_id AS old_id, CASE WHEN mean_score >= 1.3 THEN row_number() OVER (PARTITION BY mean_score >= 1.3 ORDER BY instance_id) - 1 END AS new_id,
 CASE WHEN mean_score < 1.3 THEN 'mean_score_below_threshold' END AS reason FROM i""")
def mean_score_filter(spark, sf):
    """Instances below the threshold keep a reason; the others are renumbered densely in their order.

    The numbering runs over instances, one row each, not over points."""
    i = instances(spark, sf).withColumn("ok", F.col("mean_score") >= 1.3)
    number = F.row_number().over(Window.partitionBy("ok").orderBy("instance_id")) - 1
    return i.select(F.col("instance_id").alias("old_id"), F.when(F.col("ok"), number).cast("long").alias("new_id"), F.when(~F.col("ok"), "mean_score_below_threshold").alias("reason"))


@query(f"""WITH {INSTANCES}, n AS (SELECT instance_id, ['chair','table','door','lamp'][instance_id % 4 + 1] AS label FROM i)
SELECT instance_id, concat(label, '_', row_number() OVER (PARTITION BY label ORDER BY instance_id)) AS name FROM n""")
def instance_names(spark, sf):
    names = F.array(*[F.lit(v) for v in ("chair", "table", "door", "lamp")])
    i = instances(spark, sf).select("instance_id", F.element_at(names, (F.col("instance_id") % 4 + 1).cast("int")).alias("label"))
    k = F.row_number().over(Window.partitionBy("label").orderBy("instance_id"))
    return i.select("instance_id", F.concat("label", F.lit("_"), k.cast("string")).alias("name"))


@query(f"WITH {INSTANCES}, r AS (SELECT *, row_number() OVER (ORDER BY points DESC, instance_id) rn FROM i WHERE points >= 5) SELECT instance_id, points FROM r WHERE rn <= 40")
def largest_instances(spark, sf):
    return instances(spark, sf).where("points >= 5").orderBy(F.desc("points"), "instance_id").limit(40).select("instance_id", "points")


PRED = """p AS (SELECT vec_id, label AS gt, CAST((label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS INT) AS pred FROM embeddings WHERE label <> 9)"""


def _predictions(spark, sf):
    e = table(spark, sf, "embeddings").where("label <> 9")
    return e.select("vec_id", F.col("label").alias("gt"), ((F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 10).cast("int").alias("pred"))


@query(f"WITH {PRED} SELECT gt, pred, count(*) n FROM p GROUP BY gt, pred")
def confusion_matrix(spark, sf):
    return _predictions(spark, sf).groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


IOU = f"""{PRED}, k AS (SELECT CAST(i AS INT) AS class FROM range(10) t(i)), c AS (SELECT class, (SELECT count(*) FROM p WHERE gt=class AND pred=class) tp, (SELECT count(*) FROM p WHERE gt=class) g, (SELECT count(*) FROM p WHERE pred=class) q FROM k)"""


def _iou(spark, sf):
    p = _predictions(spark, sf)
    sides = p.select(F.explode(F.array(F.struct(F.col("gt").alias("class"), F.lit(1).alias("g"), F.lit(0).alias("q")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("g"), F.lit(1).alias("q")))).alias("s"), (F.col("gt") == F.col("pred")).alias("hit"))
    sums = sides.groupBy("s.class").agg(F.sum("s.g").alias("g"), F.sum("s.q").alias("q"), F.sum(F.when(F.col("hit"), F.col("s.g")).otherwise(0)).alias("tp"))
    classes = spark.range(10).select(F.col("id").cast("int").alias("class"))
    return classes.join(sums, "class", "left").na.fill(0).withColumn("union", F.col("g") + F.col("q") - F.col("tp"))


@query(f"WITH {IOU} SELECT class, CASE WHEN g+q-tp > 0 THEN round(tp/(g+q-tp),6) ELSE 0 END AS iou, CASE WHEN g > 0 THEN round(tp/g,6) ELSE 0 END AS accuracy FROM c")
def class_iou(spark, sf):
    """Classes without any member have 0, and count in means."""
    zero = F.lit(0.0)
    return _iou(spark, sf).select("class", F.when(F.col("union") > 0, F.round(F.col("tp") / F.col("union"), 6)).otherwise(zero).alias("iou"), F.when(F.col("g") > 0, F.round(F.col("tp") / F.col("g"), 6)).otherwise(zero).alias("accuracy"))


@query(f"""WITH {IOU} SELECT CASE WHEN class < 3 THEN 'head' WHEN class < 7 THEN 'common' ELSE 'tail' END AS subset, round(avg(CASE WHEN g+q-tp > 0 THEN tp/(g+q-tp) ELSE 0 END),6) AS miou FROM c GROUP BY 1""")
def subset_miou(spark, sf):
    subset = F.when(F.col("class") < 3, "head").when(F.col("class") < 7, "common").otherwise("tail")
    iou = F.when(F.col("union") > 0, F.col("tp") / F.col("union")).otherwise(0.0)
    return _iou(spark, sf).groupBy(subset.alias("subset")).agg(F.round(F.avg(iou), 6).alias("miou"))


@query("""WITH s AS (SELECT d.doc_id, d.n_chars AS score, l.toxic FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT doc_id, score, sum(toxic) OVER (ORDER BY score DESC, doc_id) AS tp, row_number() OVER (ORDER BY score DESC, doc_id) AS n, sum(toxic) OVER () AS pos, toxic FROM s),
e AS (SELECT *, max(tp/n) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM c)
SELECT round(sum(CASE WHEN toxic = 1 THEN envelope/pos ELSE 0 END), 6) AS ap FROM e""")
def average_precision(spark, sf):
    """Area under the precision envelope of a ranking: labelled rows only, in one order of score."""
    s = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score")).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    e = masks.ranked_precision(s, "score", "doc_id", "toxic")
    pos = F.sum("toxic")
    return e.agg(F.round(F.sum(F.when(F.col("toxic") == 1, F.col("envelope")).otherwise(0.0)) / pos, 6).alias("ap"))


@query("SELECT l_linenumber AS caption_id, round(sum(l_quantity*l_tax)/sum(l_quantity),6) AS loss FROM lineitem GROUP BY 1")
def weighted_caption_loss(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("caption_id")).agg(F.round(F.sum(F.col("l_quantity") * F.col("l_tax")) / F.sum("l_quantity"), 6).alias("loss"))


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),9) AS mean FROM events""")
def running_average(spark, sf):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(own), 9).alias("mean"))


@query("""WITH m AS (SELECT label, embedding_mean FROM (SELECT label, list(e ORDER BY k) AS embedding_mean FROM (SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) e FROM embeddings, range(1,65) t(k) GROUP BY 1,2) GROUP BY label))
SELECT vec_id, CAST(arg_max(m.label, round(list_sum(list_transform(range(1,65), lambda k: CAST(embedding[k] AS DOUBLE) * embedding_mean[k])) / sqrt(list_sum(list_transform(embedding_mean, lambda v: v*v))),9)) AS INT) AS pred FROM embeddings, m GROUP BY vec_id""")
def prototype_predict(spark, sf):
    """Each vector's class by cosine to the classes' mean vectors; the prototypes are one row a class."""
    from stoa.session import broadcast_if_small

    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    means = e.groupBy("label").agg(F.array(*[F.avg(F.col("v")[k]) for k in range(64)]).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    protos = means.select(F.col("label").alias("class"), F.transform("m", lambda x: x / norm).alias("m"))
    dot = F.aggregate(F.zip_with("v", "m", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = e.join(broadcast_if_small(protos, 10_000)).select("vec_id", "class", F.round(dot, 9).alias("s"))
    return scored.groupBy("vec_id").agg(F.min_by("class", F.struct(-F.col("s"), "class")).alias("pred"))


@query("""WITH s AS (SELECT x.label AS batch, x.vec_id AS i, y.vec_id AS j, 4 * list_inner_product(CAST(x.embedding AS DOUBLE[]), list_reverse(CAST(y.embedding AS DOUBLE[]))) AS v FROM embeddings x JOIN embeddings y USING (label)),
r AS (SELECT batch, i, ln(sum(exp(v))) - sum(CASE WHEN i = j THEN v ELSE 0 END) AS lost FROM s GROUP BY 1, 2), c AS (SELECT batch, j, ln(sum(exp(v))) - sum(CASE WHEN i = j THEN v ELSE 0 END) AS lost FROM s GROUP BY 1, 2),
b AS (SELECT batch, avg(ln(1 + exp(CASE WHEN i = j THEN -(v - 1) ELSE v - 1 END))) AS sigmoid FROM s GROUP BY 1)
SELECT CAST(batch AS BIGINT) AS batch, n, round(softmax, 6) AS softmax, round(sigmoid, 6) AS sigmoid FROM (SELECT batch, count(*) // 2 AS n, avg(lost) AS softmax FROM (SELECT batch, lost FROM r UNION ALL SELECT batch, lost FROM c) GROUP BY 1) JOIN b USING (batch)""")
def contrastive_scores(spark, sf):
    """How well features find their partners in a batch, here the vectors of a label and themselves reversed."""
    from stoa.operators import contrast

    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("batch"), F.col("vec_id").alias("item"), v.alias("a"), F.reverse(v).alias("b"))
    out = contrast.contrastive(rows, scale=4.0, bias=-1.0, block=64)
    return out.select("batch", "n", F.round("softmax", 6).alias("softmax"), F.round("sigmoid", 6).alias("sigmoid"))


@query("""WITH m AS (SELECT label, vec_id, CAST(embedding[k] AS DOUBLE) * 9 AS x, CASE WHEN embedding[k % 64 + 1] > 0 THEN 1.0::DOUBLE ELSE 0 END AS t FROM embeddings, range(1, 65) r(k)),
s AS (SELECT label, vec_id, 1 - (2 * sum(t / (1 + exp(-x))) + 1) / (sum(1 / (1 + exp(-x))) + sum(t) + 1) AS dice, avg(ln(1 + exp(-x)) + x * (1 - t)) AS cross_loss FROM m GROUP BY 1, 2)
SELECT CAST(label AS BIGINT) AS scene, count(*) AS masks, round(avg(dice), 6) AS dice, round(avg(cross_loss), 6) AS cross_loss FROM s GROUP BY 1""")
def mask_losses(spark, sf):
    """Dice loss and binary cross-entropy of masks, a mean a scene: vectors are masks of 64 points, their neighbours' signs the truth."""
    from stoa.operators import contrast

    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("scene"), "vec_id", "embedding", F.posexplode("embedding").alias("k", "x"))
    cells = e.select("scene", "vec_id", (F.col("x").cast("double") * 9).alias("logit"), (F.get("embedding", (F.col("k") + 1) % 64) > 0).cast("int").alias("target"))
    out = contrast.mask_losses(cells, "scene", "vec_id", "logit", "target")
    return out.select("scene", "masks", F.round("dice", 6).alias("dice"), F.round("cross", 6).alias("cross_loss"))


@query("""WITH s AS (SELECT vec_id % 7 AS part, label, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE) * 4) AS z FROM embeddings WHERE label <> 9) SELECT part, count(*) AS n, round(avg(ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[label + 1]), 6) AS loss FROM s GROUP BY 1""")
def class_cross_entropy(spark, sf):
    """Mean cross-entropy of ten logits against the true class; the ignored class takes no part."""
    from stoa.operators import contrast

    z = F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * 4)
    lost = table(spark, sf, "embeddings").select((F.col("vec_id") % 7).alias("part"), contrast.class_cross(z, F.col("label"), 9).alias("lost")).where("lost is not null")
    return lost.groupBy("part").agg(F.count("lost").alias("n"), F.round(F.avg("lost"), 6).alias("loss"))
