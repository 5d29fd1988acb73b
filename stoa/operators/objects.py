"""Object boxes and their labels: plausibility, quality flags, spatial relations, hierarchy, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoa.operators import relations

# fixed values: of each label, least and most height, least and most width, most depth, most footprint, name, word for depth
SHAPES = {
    "door": (1.20, 4.20, 0.35, 3.50, 1.30, 7.00, "door", "deep/thick"),
    "elevator": (1.60, 4.20, 0.70, 5.00, 2.00, 10.00, "elevator", "deep/thick"),
    "water dispenser": (0.50, 3.00, 0.20, 2.50, 1.20, 3.00, "water dispenser", "deep"),
    "water dispensor": (0.50, 3.00, 0.20, 2.50, 1.20, 3.00, "water dispenser", "deep"),
    "whiteboard": (0.25, 3.50, 0.30, 8.00, 1.40, 12.00, "whiteboard", "deep/thick"),
    "noticeboard": (0.25, 3.50, 0.30, 8.00, 1.40, 12.00, "noticeboard", "deep/thick"),
    "notice board": (0.25, 3.50, 0.30, 8.00, 1.40, 12.00, "notice board", "deep/thick"),
    "projector screen": (0.25, 3.50, 0.30, 8.00, 1.40, 12.00, "projector screen", "deep/thick"),
}
# fixed values: of each label, chains of checks (first that holds of a chain): metric, below or above, bound, level, message
QUALITY = {
    "door": [
        [("height", "<", 1.20, 2, "too short for door"), ("height", "<", 1.60, 1, "short for door")], [("height", ">", 4.00, 1, "too tall for normal door")],
        [("wide", "<", 0.35, 1, "too narrow for door")], [("wide", ">", 3.50, 2, "too wide for single door"), ("wide", ">", 2.40, 1, "wide door-like object")],
        [("deep", ">", 1.30, 1, "too thick/deep for door")], [("area", ">", 7.00, 2, "door footprint too large")],
    ],
    "elevator": [
        [("score", "<", 0.035, 1, "weak elevator confidence")], [("height", "<", 1.60, 2, "too short for elevator entrance"), ("height", "<", 1.90, 1, "short for elevator entrance")],
        [("height", ">", 4.20, 1, "too tall for elevator entrance")], [("wide", "<", 0.70, 1, "too narrow for elevator entrance")],
        [("wide", ">", 5.00, 2, "too wide for elevator entrance"), ("wide", ">", 3.50, 1, "wide elevator-like surface")], [("deep", ">", 2.00, 1, "too deep/thick for elevator face")],
    ],
    "water dispenser": [
        [("height", "<", 0.50, 2, "too short for water dispenser"), ("height", "<", 0.90, 1, "short for water dispenser")],
        [("height", ">", 3.00, 2, "too tall for water dispenser"), ("height", ">", 2.20, 1, "tall for water dispenser")], [("wide", "<", 0.20, 1, "too narrow for water dispenser")],
        [("wide", ">", 2.50, 2, "too wide for water dispenser"), ("wide", ">", 1.50, 1, "wide for water dispenser")], [("deep", ">", 1.20, 1, "too deep for water dispenser")],
    ],
}
QUALITY["water dispensor"] = QUALITY["water dispenser"]
SCORES = [("score", "<", 0.020, 2, "very low mean_score"), ("score", "<", 0.025, 1, "low mean_score")]
_SHOWN = {"height": ": height %.2fm", "wide": ": width %.2fm", "deep": ": depth %.2fm", "area": ": %.2fm2", "score": " %.3f"}
# fixed values: substrings of labels that are assets, whatever stands on them; and the labels of the readable tree's assets
FIXTURES = ("table", "desk", "bed", "chair", "couch", "sofa", "bench", "shelf", "bookshelf", "cabinet", "wardrobe", "drawer", "tv stand", "shoe rack", "rug", "workstation", "workbench")
READABLE = ("cabinet", "chair", "couch", "desk", "shelf", "sofa", "table", "workbench", "workstation")


def metrics() -> dict[str, Column]:
    """``height, wide, deep, area`` of the box ``x0, x1, y0, y1, z0, z1``."""
    c = F.col
    dx, dy = F.greatest(c("x1") - c("x0"), F.lit(0.0)), F.greatest(c("y1") - c("y0"), F.lit(0.0))
    tiny = F.lit(1e-6)
    return {"height": F.greatest(c("z1") - c("z0"), F.lit(0.0)), "wide": F.greatest(dx, dy), "deep": F.least(dx, dy), "area": F.greatest(dx, tiny) * F.greatest(dy, tiny)}


def shape_reason(key: Column) -> Column:
    """Why a label (as ``label_key``) can't have the box ``x0 .. z1``: the first rule that fails; null if none does."""
    m = {k: F.round(v, 9) for k, v in metrics().items()}
    out = []
    for label, (h0, h1, w0, w1, d1, a1, name, deep) in SHAPES.items():
        said = lambda bad, text, metric, name=name: F.when(bad, F.format_string(f"{name} {text}", m[metric]))
        rules = F.coalesce(
            said(m["height"] < h0, "too short: height %.2fm", "height"), said(m["height"] > h1, "too tall: height %.2fm", "height"),
            said(m["wide"] < w0, "too narrow: width %.2fm", "wide"), said(m["wide"] > w1, "too wide: width %.2fm", "wide"),
            said(m["deep"] > d1, f"too {deep}: depth %.2fm", "deep"), said(m["area"] > a1, "footprint too large: %.2fm2", "area"),
        )
        out.append(F.when(key == label, rules))
    return F.coalesce(*out)


def quality(key: Column, score: Column) -> Column:
    """``struct<status, reasons>``: all flags of a watched label's box and mean score; the worst gives the status."""
    m = {k: F.round(v, 9) for k, v in metrics().items()} | {"score": score}
    flags = F.array().cast("array<struct<level: int, said: string>>")
    for label, chains in QUALITY.items():
        tests = []
        for chain in [SCORES, *chains]:
            hit = F.lit(None).cast("struct<level: int, said: string>")
            for metric, side, bound, level, text in reversed(chain):
                bad = m[metric] < bound if side == "<" else m[metric] > bound
                shown = F.format_string(text + _SHOWN[metric], m[metric])
                hit = F.when(bad, F.struct(F.lit(level).alias("level"), shown.alias("said"))).otherwise(hit)
            tests.append(hit)
        flags = F.when(key == label, F.array_compact(F.array(*tests))).otherwise(flags)
    worst = F.aggregate(flags, F.lit(0), lambda s, f: F.greatest(s, f["level"]))
    status = F.when(worst >= 2, "likely_wrong").when(worst == 1, "review").otherwise("likely_correct")
    return F.struct(status.alias("status"), F.transform(flags, lambda f: f["said"]).alias("reasons"))


def spatial_edges(boxes: DataFrame, key: str, overlap: float = 0.3, near: float = 2.5, gap: float = 0.15, next_cap: int = 3, above_cap: int = 8, wanted: tuple[str, ...] = ()) -> DataFrame:
    """``(src, dst, relation)`` of object boxes, one relation a pair: inside, else on, else above, else next-to.

    ``boxes`` hold ``key``, the box ``x0 .. z1`` and a centroid ``cx, cy, cz`` within it. Each source keeps its
    ``above_cap`` and ``next_cap`` nearest, which is those relations' definition; ties go by the pair's keys. ``wanted``
    names the relations to give, all by default; inside and on need touching boxes only, and no ranks.
    """
    tight = bool(wanted) and set(wanted) <= {"inside", "on"}
    c = F.col
    tiny = F.lit(1e-9)
    size = {a: c(f"{a}1") - c(f"{a}0") for a in "xyz"}
    own = {"vol": size["x"] * size["y"] * size["z"], "area": size["x"] * size["y"], "span": size["z"]}  # of a box, not of each of its pairs
    held = boxes.select(key, *[f"{a}{k}" for a in "xyz" for k in "01"], "cx", "cy", "cz", *[F.greatest(tiny, v).alias(k) for k, v in own.items()])
    p = relations.box_pairs(held, key, 0.0 if tight else near)
    share = lambda a: F.greatest(F.least(c(f"a_{a}1"), c(f"b_{a}1")) - F.greatest(c(f"a_{a}0"), c(f"b_{a}0")), F.lit(0.0))
    p = p.withColumns({"inter": share("x") * share("y"), "zs": share("z"), "flat": F.hypot(c("a_cx") - c("b_cx"), c("a_cy") - c("b_cy")), "up": c("a_cz") - c("b_cz")})
    p = p.withColumn("iou", c("inter") / (c("a_area") + c("b_area") - c("inter") + tiny)).where((c("inter") > 0) | (c("flat") < near))  # no relation holds of other pairs

    def within(a: str, b: str) -> Column:
        return (c("inter") / (c(f"{a}_area") + tiny) > 0.8) & (c("zs") / c(f"{a}_span") > 0.8) & (c(f"{b}_vol") / c(f"{a}_vol") > 3.0)

    def rests(a: str, b: str) -> Column:
        return (c("iou") > overlap) & (F.abs(c(f"{a}_z0") - c(f"{b}_z1")) < gap) & (c(f"{a}_cz") > c(f"{b}_cz"))

    solid = F.sqrt(c("flat") * c("flat") + c("up") * c("up"))
    a, b = c(f"a_{key}"), c(f"b_{key}")
    edge = lambda src, dst, name, far: F.struct(src.alias("src"), dst.alias("dst"), F.lit(name).alias("relation"), far.alias("far"))
    none = F.lit(0.0)
    found = (
        F.when(within("a", "b"), edge(a, b, "inside", none)).when(within("b", "a"), edge(b, a, "inside", none))
        .when(rests("a", "b"), edge(a, b, "on", none)).when(rests("b", "a"), edge(b, a, "on", none))
        .when((c("flat") < near) & (c("up") > 0.3), edge(a, b, "above", c("flat"))).when((c("flat") < near) & (c("up") < -0.3), edge(b, a, "above", c("flat")))
        .when(solid < near, edge(a, b, "next_to", solid))
    )
    e = p.select(found.alias("e")).select("e.*").where(F.col("relation").isin(*wanted) if wanted else F.col("relation").isNotNull())
    if tight:
        return e.select("src", "dst", "relation")
    rank = F.row_number().over(Window.partitionBy("src", "relation").orderBy(F.round("far", 9), F.least("src", "dst"), F.greatest("src", "dst")))
    most = F.when(c("relation") == "above", above_cap).when(c("relation") == "next_to", next_cap)
    return e.withColumn("rank", rank).where(most.isNull() | (c("rank") <= most)).select("src", "dst", "relation")


def hierarchy(items: DataFrame, edges: DataFrame, key: str, label: str = "label") -> DataFrame:
    """``items`` with ``role``: ``asset`` if something is on it or its label names one, else ``object``."""
    under = edges.where("relation = 'on'").select(F.col("dst").alias("_under")).distinct()
    fixture = F.lit(False)
    for word in FIXTURES:
        fixture |= F.contains(F.lower(label), F.lit(word))
    held = items.join(under, F.col(key) == F.col("_under"), "left")
    return held.select(*[held[c] for c in items.columns], F.when(fixture | F.col("_under").isNotNull(), "asset").otherwise("object").alias("role"))


def relabelled(evidence: DataFrame, items: DataFrame, key: str, least_score: float, least_margin: float, unknown: str, unknown_score: float, unknown_margin: float) -> DataFrame:
    """Each item's new label by its evidence, with what kept it from one.

    ``evidence``: ``key, label, score``; ``items``: ``key, label, x0 .. z1``. Candidates go by score (ties by label).
    The best whose shape is plausible is chosen, or the best of all if none is; the margin is to the second
    plausible one. A weak choice becomes ``unknown``; if none is set, it is blocked.
    """
    own = items.select(key, F.col("label").alias("before"), "x0", "x1", "y0", "y1", "z0", "z1")
    told = evidence.join(own, key).withColumn("bad", shape_reason(F.lower("label")).isNotNull())
    order = [F.desc("score"), F.col("label")]
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("sound", F.row_number().over(Window.partitionBy(key, "bad").orderBy(*order)))
    pick = lambda test, value: F.max(F.when(test, F.col(value)))
    good = ~F.col("bad")
    top = told.groupBy(key).agg(
        pick(F.col("rank") == 1, "label").alias("raw_label"), pick(F.col("rank") == 1, "score").alias("raw_score"), pick(good & (F.col("sound") == 1), "label").alias("sound_label"),
        pick(good & (F.col("sound") == 1), "score").alias("sound_score"), F.coalesce(pick(good & (F.col("sound") == 2), "score"), F.lit(0.0)).alias("second"),
    )
    best, score = F.coalesce("sound_label", "raw_label"), F.coalesce("sound_score", "raw_score")
    top = top.select(key, "raw_label", best.alias("best"), score.alias("score"), (score - F.col("second")).alias("margin"))
    doubt = (F.col("best") != unknown) & ((F.col("score") < unknown_score) | (F.col("margin") < unknown_margin))
    block = F.when(F.col("score").isNull(), "no_evidence").when(doubt, F.lit(None)).when(F.col("score") < least_score, "best_score_below_threshold").when(F.col("margin") < least_margin, "margin_below_threshold")
    out = own.join(top, key, "left").withColumn("blocked", block)
    new = F.when(F.col("blocked").isNotNull(), F.col("before")).when(doubt, unknown).otherwise(F.col("best"))
    return out.select(key, "before", new.alias("label"), "score", "margin", "blocked", (F.col("best") != F.col("raw_label")).alias("corrected"))


def resume_state(prediction: Column, labels: Column, wanted: Column, prompts: Column, wanted_prompts: Column) -> Column:
    """``pending`` without a prediction, ``redo`` if it was made with other labels or prompts, else ``done``."""
    return F.when(prediction.isNull(), "pending").when((labels != wanted) | (prompts != wanted_prompts), "redo").otherwise("done")
