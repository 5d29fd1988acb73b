"""Graphs as edge tables ``src, dst[, relation]``."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stoa.session import broadcast_if_small, cut, written


def tree(edges: DataFrame, root: str) -> DataFrame:
    """``(node, path, depth)`` below a root, one join a level; a node never recurs within its own path."""
    level = edges.sparkSession.createDataFrame([(root, [root], 0)], "node string, trail array<string>, depth int")
    found = level
    for depth in count(1):
        step = edges.join(level, edges["src"] == level["node"]).where(~F.expr("array_contains(trail, dst)"))
        level = cut(step.select(F.col("dst").alias("node"), F.concat("trail", F.array("dst")).alias("trail"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.select("node", F.array_join("trail", "/").alias("path"), "depth")


def with_inverse(edges: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """``(node, other, relation)``: each edge from its source, and from its target where its relation has an inverse."""
    pairs = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])
    ahead = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "relation")
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), pairs[F.col("relation")].alias("relation"))
    return ahead.unionByName(back.where("relation is not null"))


def distances(edges: DataFrame, start: int) -> DataFrame:
    """``(node, hops)`` of all nodes within reach: each wave meets only nodes not yet seen.

    The edges are made once. A wave is broadcast while it is counted to be small, else both sides are shuffled.
    """
    kind = edges.schema["src"].dataType.simpleString()
    edges = written(edges.select("src", "dst"), "edges")
    seen = wave = cut(edges.sparkSession.createDataFrame([(start, 0)], f"node {kind}, hops int"))
    for hops in count(1):
        near = wave.select("node")
        held = broadcast_if_small(near)
        ahead = edges.join(near.hint("merge") if held is near else held, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        wave = written(ahead.join(seen.select("node").hint("merge"), "node", "left_anti").withColumn("hops", F.lit(hops)), "wave")
        if wave.isEmpty():
            break
        seen = seen.unionByName(wave)
    return seen


def broken_steps(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps whose node doesn't follow an edge from the step before."""
    before = F.lag("node").over(Window.partitionBy("plan_id").orderBy("step"))
    moves = steps.withColumn("before", before).where("before is not null")
    return moves.join(edges, (edges["src"] == moves["before"]) & (edges["dst"] == moves["node"]), "left_anti")


def _searched(edges: DataFrame, begun: DataFrame, through: DataFrame | None) -> DataFrame:
    """``(start, bound, node, path)`` by waves from ``begun`` (``start, bound``), each of which meets only nodes that its start hasn't seen."""
    edges = written(edges.select("src", "dst", "place"), "edges")
    begun = begun.select("start", "bound", F.col("start").alias("node"), F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("places"))
    seen = wave = written(begun.distinct(), "paths")
    while True:
        ahead = wave.join(edges, wave["node"] == edges["src"]).select("start", "bound", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("places", F.array(F.col("place").cast("int"))).alias("places"))
        first = ahead.groupBy("start", "bound", "node").agg(F.min_by(F.struct("path", "places"), "places").alias("p")).select("start", "bound", "node", "p.*")
        wave = written(first.join(seen.select("start", "bound", "node"), ["start", "bound", "node"], "left_anti"), "paths")
        if wave.isEmpty():
            return seen.select("start", "bound", "node", "path")
        seen = seen.unionByName(wave)
        if through is not None:
            marked = through.select(F.col("node").alias("_marked")).distinct()
            wave = wave.join(marked, F.col("node") == F.col("_marked"), "left").where(~F.col("bound") | F.col("_marked").isNotNull()).drop("_marked")


def shortest_paths(edges: DataFrame, starts: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """``(start, node, path)``: from each start, the first shortest path to each other node within reach.

    ``edges``: ``src, dst, place``, the last being the neighbour's place in its list; of paths equally long, the one
    with the smaller places wins. If ``through`` (``node``) is given, only its nodes and starts are passed through;
    others can be ends. ``path`` leaves the start out.
    """
    return _searched(edges, starts.select("start", F.lit(through is not None).alias("bound")), through).drop("bound")


def both_paths(edges: DataFrame, starts: DataFrame, through: DataFrame) -> DataFrame:
    """``(start, node, path, bound_path)``: the shortest paths through any nodes, and those through ``through`` only (null if none), by one search."""
    begun = starts.select("start", F.explode(F.array(F.lit(False), F.lit(True))).alias("bound"))
    found = written(_searched(edges, begun, through), "both-paths")
    side = lambda bound, name: found.where(F.col("bound") == bound).select("start", "node", F.col("path").alias(name))
    return side(False, "path").join(side(True, "bound_path"), ["start", "node"], "left")


def validated_plans(plans: DataFrame, nodes: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Each plan's ``status, reason, destination, path, kinds`` on a navigation graph.

    ``plans``: ``plan_id, start, stops, grasps, talks, error``; ``nodes``: ``node, marker``; ``edges``: ``src, dst,
    place``; ``objects``: ``object``. Names match whatever their case. A leg goes through nodes marked ``O`` if it can
    (kind ``o_only``), else through any (``fallback``). The first fault in order of legs is the reason. ``path`` joins the legs.
    """
    names = nodes.groupBy(F.lower("node").alias("key")).agg(F.max("node").alias("name"))
    things = objects.select(F.lower("object").alias("thing")).distinct()
    key = lambda c: F.lower(F.trim(F.col(c)))
    begun = plans.join(names.select(F.col("key").alias("k"), F.col("name").alias("at")), key("start") == F.col("k"), "left").drop("k")
    stops = begun.select("plan_id", "at", F.posexplode("stops").alias("leg", "stop"))
    legs = stops.join(names, key("stop") == F.col("key"), "left").select("plan_id", "at", "leg", "stop", "name")
    before = F.lag("name").over(Window.partitionBy("plan_id").orderBy("leg"))
    legs = legs.withColumn("origin", F.when(F.col("leg") == 0, F.col("at")).otherwise(before))
    starts = legs.where("origin is not null").select(F.col("origin").alias("start")).distinct()
    marked = nodes.where("marker = 'O'").select("node")
    paths = both_paths(edges, starts, marked).select(F.col("start").alias("origin"), F.col("node").alias("name"), F.col("path").alias("any"), F.col("bound_path").alias("short"))
    legs = legs.join(paths, ["origin", "name"], "left")
    fault = F.when(F.col("name").isNull(), F.concat(F.lit("Node does not exist: "), "stop")).when(F.col("any").isNull(), F.concat(F.lit("No path found for segment "), (F.col("leg") + 1).cast("string")))
    legs = legs.select("plan_id", F.struct("leg", "name", fault.alias("fault"), F.coalesce("short", "any").alias("path"), F.when(F.col("short").isNotNull(), "o_only").otherwise("fallback").alias("kind")).alias("s"))
    walked = legs.groupBy("plan_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # one plan's legs
    missing = begun.select("plan_id", F.posexplode("grasps").alias("i", "grasp")).join(things, key("grasp") == F.col("thing"), "left_anti")
    missing = missing.groupBy("plan_id").agg(F.min_by("grasp", "i").alias("lost"))
    all_ = begun.join(walked, "plan_id", "left").join(missing, "plan_id", "left")
    leg_fault = F.get(F.array_compact(F.transform("s", lambda x: x["fault"])), F.lit(0))
    nothing = F.size("stops") == 0
    reason = F.coalesce(
        F.col("error"), F.when(F.col("at").isNull(), F.concat(F.lit("Start node does not exist: "), "start")),
        F.when(nothing & F.col("lost").isNotNull(), F.concat(F.lit("Object not present in scene graph: "), "lost")), F.when(~nothing, leg_fault),
    )
    good = F.when(reason.isNull(), F.lit(True))
    return all_.select(
        "plan_id", F.when(good, "VALID").otherwise("INVALID").alias("status"), reason.alias("reason"),
        F.when(good, F.coalesce(F.element_at(F.transform("s", lambda x: x["name"]), -1), F.col("at"))).alias("destination"),
        F.when(good, F.flatten(F.coalesce(F.transform("s", lambda x: x["path"]), F.array().cast("array<array<string>>")))).alias("path"),
        F.when(good, F.coalesce(F.transform("s", lambda x: x["kind"]), F.array().cast("array<string>"))).alias("kinds"),
    )
