"""Manifests as tables: label lists, prompt lists, room polygons, navigation graphs, splits and occupancy rasters.

Each reader takes a path of text or JSON files (whole files, one document each) and gives rows; the parsing itself
is a DataFrame function, so the same works on a column of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stoa.functions.text import label_key, natural_key

ROOM = "room_id string, id string, room_type string, type string, polygon_xy array<array<double>>, polygon array<array<double>>"
NODE = "node_name string, name string, neighbor_nodes array<string>, neighbor_room array<string>, node_marker string, marker string"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, text``: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def label_lines(texts: DataFrame, *keys: str) -> DataFrame:
    """``(keys, label_index, label)``: trimmed lines in order, without blank ones and comments; under two labels are no list."""
    kept = F.filter(F.transform(F.split("text", r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    own = texts.select(*keys, kept.alias("l")).where(F.size("l") >= 2)
    return own.select(*keys, F.posexplode("l").alias("label_index", "label"))


def prompts(texts: DataFrame, *keys: str) -> DataFrame:
    """``(keys, label, place, prompt)`` of JSON objects from labels to a prompt or a list of them; empty prompts go."""
    each = texts.select(*keys, F.explode(F.from_json("text", "map<string, string>")).alias("raw", "said"))
    many = F.when(F.startswith(F.trim("said"), F.lit("[")), F.from_json("said", "array<string>")).otherwise(F.array("said"))
    kept = F.filter(F.transform(many, lambda x: F.trim(x)), lambda x: x != "")
    return each.select(*keys, label_key(F.col("raw")).alias("label"), F.posexplode(kept).alias("place", "prompt"))


def prompt_texts(labels: DataFrame, given: DataFrame, template: str = "a photo of a {}", other: str = "other") -> DataFrame:
    """``(label, place, prompt)`` of each label: its own prompts with ``{}`` filled in, else the template; ``other`` stays bare."""
    own = labels.select("label", label_key(F.col("label")).alias("_key"))
    asked = own.join(given.select(F.col("label").alias("_key"), "place", "prompt"), "_key", "left")
    bare = F.when(F.col("_key") == other, F.col("label")).otherwise(F.replace(F.lit(template), F.lit("{}"), F.col("label")))
    return asked.select("label", F.coalesce("place", F.lit(0)).alias("place"), F.coalesce(F.replace("prompt", F.lit("{}"), F.col("label")), bare).alias("prompt"))


def rooms(texts: DataFrame, *keys: str) -> DataFrame:
    """``(keys, place, room_id, room_type, polygon_xy)`` of ``{"rooms": [...]}``, whichever names the fields go by.

    Rooms of fewer than three vertices go; a room without an id is named by its place.
    """
    found = texts.select(*keys, F.posexplode(F.from_json("text", f"rooms array<struct<{ROOM}>>")["rooms"]).alias("place", "r"))
    polygon = F.coalesce("r.polygon_xy", "r.polygon")
    return found.select(
        *keys, "place", F.coalesce("r.room_id", "r.id", F.format_string("room_%03d", "place")).alias("room_id"),
        F.coalesce("r.room_type", "r.type", F.lit("room")).alias("room_type"), polygon.alias("polygon_xy"),
    ).where(F.size("polygon_xy") >= 3)


def nav_nodes(texts: DataFrame) -> DataFrame:
    """``(node, marker, neighbours)`` of navigation graphs, a list of nodes or ``{"nodes": [...]}``; markers are S or O."""
    listed = F.when(F.startswith(F.trim("text"), F.lit("[")), F.from_json("text", f"array<struct<{NODE}>>")).otherwise(F.from_json("text", f"nodes array<struct<{NODE}>>")["nodes"])
    n = texts.select(F.explode(listed).alias("n"))
    name, mark = F.trim(F.coalesce("n.node_name", "n.name")), F.upper(F.coalesce("n.node_marker", "n.marker", F.lit("S")))
    return n.select(name.alias("node"), F.when(mark == "O", "O").otherwise("S").alias("marker"), F.coalesce("n.neighbor_nodes", "n.neighbor_room", F.array().cast("array<string>")).alias("neighbours")).where("node <> ''")


def nav_edges(nodes: DataFrame) -> DataFrame:
    """``(src, dst, place)`` of the nodes' neighbours; names take their node's case, unknown ones stay as they are."""
    known = nodes.groupBy(F.lower("node").alias("_key")).agg(F.max("node").alias("_name"))
    said = nodes.select(F.col("node").alias("src"), F.posexplode(F.array_compact("neighbours")).alias("place", "said"))
    return said.join(known, F.lower("said") == F.col("_key"), "left").select("src", F.coalesce("_name", "said").alias("dst"), "place")


def split_names(texts: DataFrame, repeat: int = 1) -> DataFrame:
    """``(place, name)`` of the scenes of a split: lines that are no comment, in natural order, all of them ``repeat`` times."""
    lines = texts.select(F.explode(F.split("text", r"\r\n|\n|\r")).alias("name")).where("trim(name) <> '' and not startswith(name, '#')")
    ranked = lines.withColumn("_rank", F.row_number().over(Window.orderBy(natural_key(F.col("name")), "name")) - 1)  # one row a scene
    n = lines.agg(F.count(F.lit(1)).alias("_n"))
    turns = ranked.crossJoin(F.broadcast(n)).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    return turns.select((F.col("_turn") * F.col("_n") + F.col("_rank")).alias("place"), "name")


def occupancy(gray: Column, negate: bool = False, occupied: float = 0.65, free: float = 0.196) -> Column:
    """``occupied``, ``free`` or ``unknown`` of a gray value from 0 to 255."""
    share = gray / 255.0 if negate else 1 - gray / 255.0
    return F.when(share >= occupied, "occupied").when(share <= free, "free").otherwise("unknown")


def latest_session(files: DataFrame, required: list[str]) -> DataFrame:
    """``(root, session)``: of each root the session whose summary is newest, among those with all the ``required`` files.

    ``files``: ``root, session, name, modified``; the summary is ``summary.json``; ties go to the later name.
    """
    sessions = files.groupBy("root", "session").agg(F.collect_set("name").alias("names"), F.max(F.when(F.col("name") == "summary.json", F.col("modified"))).alias("modified"))
    whole = sessions.where(F.size(F.array_except(F.array(*[F.lit(r) for r in required]), "names")) == 0)
    return whole.groupBy("root").agg(F.max_by("session", F.struct("modified", "session")).alias("session"))
