"""Queries over manifests and files: they write what the driver's tables give to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.functions.colours import whole_colours
from stoa.operators import sampling
from stoa.operators.objects import resume_state
from stoa.operators.points import centred
from stoa.plans.registry import query
from stoa.session import scratch, table
from stoa.sources import manifests


def _filed(spark, texts, name: str):
    """A column ``text`` written as files of one document a line, in hexadecimal digits, and read again."""
    path = scratch(spark, name)
    texts.select(F.hex(F.encode("text", "UTF-8")).alias("value")).write.text(path)
    return spark.read.text(path).select(F.decode(F.unhex("value"), "UTF-8").alias("text"))


@query(r"""WITH l AS (SELECT item_id, list_filter(list_transform(string_split('# labels' || chr(10) || replace(text, ' ', chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')) AS ws FROM benchmark)
SELECT item_id, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS label_index, unnest(ws) AS label FROM l WHERE len(ws) >= 2""")
def label_list(spark, sf):
    """Label lists: a line a label, blanks and comments left out."""
    b = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("# labels\n"), F.replace("text", F.lit(" "), F.lit("\n"))).alias("text"))
    return manifests.label_lines(b, "item_id")


@query(r"""WITH p AS (SELECT p_partkey, p_type AS label, p_partkey % 4 AS k, p_name FROM part) SELECT p_partkey, label, CAST(place AS INT) AS place, prompt FROM (
SELECT p_partkey, label, 0 AS place, CASE WHEN k = 0 THEN label || ' in a room' WHEN k = 1 THEN p_name ELSE 'a photo of a ' || label END AS prompt FROM p UNION ALL SELECT p_partkey, label, 1, 'the ' || label FROM p WHERE k = 0)""")
def prompt_ensembles(spark, sf):
    """Prompts of each label from a JSON object; labels without one take the template."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.to_json(F.create_map("p_type", F.array(F.lit("{} in a room"), F.lit(" "), F.lit(" the {} "))))).when(k == 1, F.to_json(F.create_map("p_type", "p_name")))
    given = manifests.prompts(p.select("p_partkey", text.alias("text")).where("text is not null"), "p_partkey")
    given = given.select(F.concat_ws(" ", "p_partkey", "label").alias("label"), "place", "prompt")
    asked = manifests.prompt_texts(p.select(F.concat_ws(" ", "p_partkey", "p_type").alias("label")), given)
    key = F.split("label", " ", 2)
    bare = lambda c: F.replace(c, F.concat(key[0], F.lit(" ")), F.lit(""))
    number = F.row_number().over(Window.partitionBy("label").orderBy("place")) - 1
    return asked.select(key[0].cast("long").alias("p_partkey"), key[1].alias("label"), number.alias("place"), bare(F.col("prompt")).alias("prompt"))


@query("""SELECT r_regionkey, CAST(p AS INT) AS place, CASE WHEN n_nationkey % 3 = 2 THEN printf('room_%03d', p) ELSE n_name END AS room_id, CASE WHEN n_nationkey % 2 = 0 THEN 'office' ELSE 'room' END AS room_type, CAST(4 - n_nationkey % 2 AS INT) AS vertices
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS p FROM nation) JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 <> 4""")
def room_polygons(spark, sf):
    """Rooms of one manifest a region: other field names, missing ids and polygons of two vertices included."""
    k = F.col("n_nationkey")
    x = k.cast("double")
    square = F.array(F.array(x, F.lit(0.0)), F.array(x + 1, F.lit(0.0)), F.array(x + 1, F.lit(1.0)), F.array(x, F.lit(1.0)))
    polygon = F.slice(square, F.lit(1), F.when(k % 5 == 4, 2).otherwise(4 - k % 2).cast("int"))
    none = F.lit(None)
    room = F.struct(
        F.when(k % 3 == 0, F.col("n_name")).alias("room_id"), F.when(k % 3 == 1, F.col("n_name")).alias("id"), F.when(k % 4 == 0, "office").otherwise(none).alias("room_type"), F.when(k % 4 == 2, "office").otherwise(none).alias("type"),
        F.when(k % 2 == 0, polygon).alias("polygon_xy"), F.when(k % 2 == 1, polygon).alias("polygon"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), room.alias("r")))), lambda s: s["r"])  # a region's nations
    texts = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.to_json(F.struct(listed.alias("rooms"))).alias("text"))
    return manifests.rooms(texts, "r_regionkey").select("r_regionkey", "place", "room_id", "room_type", F.size("polygon_xy").alias("vertices"))


@query("""SELECT a.n_name AS src, CASE WHEN d % 4 = 3 THEN 'lift ' || d ELSE b.n_name END AS dst, CAST(p AS INT) AS place, CASE WHEN a.n_nationkey % 4 = 0 THEN 'O' ELSE 'S' END AS marker
FROM (SELECT n_nationkey, n_name, p, (n_nationkey * (p + 2) + 1) % 25 AS d FROM nation, range(3) t(p)) a JOIN nation b ON b.n_nationkey = a.d""")
def nav_graph_scan(spark, sf):
    """A navigation graph from JSON: names in any case, unknown neighbours kept, markers other than O taken for S."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    step = n.select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("p")).withColumn("d", (F.col("n_nationkey") * (F.col("p") + 2) + 1) % 25)
    to = step.join(n.select(F.col("n_nationkey").alias("d"), F.col("n_name").alias("other")), "d")
    said = F.when(F.col("d") % 4 == 3, F.concat(F.lit("lift "), F.col("d").cast("string"))).otherwise(F.lower("other"))
    near = F.transform(F.array_sort(F.collect_list(F.struct("p", said.alias("s")))), lambda s: s["s"])  # three a node
    node = to.groupBy("n_nationkey", "n_name").agg(near.alias("near"))
    k = F.col("n_nationkey")
    rows = node.select(F.to_json(F.array(F.struct(
        F.when(k % 2 == 0, F.concat(F.lit(" "), "n_name")).alias("node_name"), F.when(k % 2 == 1, F.col("n_name")).alias("name"), F.when(k % 3 == 0, F.col("near")).alias("neighbor_nodes"),
        F.when(k % 3 > 0, F.col("near")).alias("neighbor_room"), F.when(k % 4 == 0, "o").when(k % 4 == 1, "x").alias("node_marker"),
    ))).alias("text"))
    wrapped = rows.withColumn("text", F.when(F.length("text") % 2 == 0, F.concat(F.lit('{"nodes": '), "text", F.lit("}"))).otherwise(F.col("text")))
    nodes = manifests.nav_nodes(_filed(spark, wrapped, "nav"))
    return manifests.nav_edges(nodes).join(nodes.select(F.col("node").alias("src"), "marker"), "src")


@query("""WITH s AS (SELECT 'scene' || s_suppkey || '_' || s_nationkey AS name, s_suppkey FROM supplier WHERE s_suppkey % 7 <> 3), r AS (SELECT name, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM s)
SELECT k + t * (SELECT count(*) FROM s) AS place, name FROM r, range(2) t(t)""")
def split_scan(spark, sf):
    """Scenes of a split in natural order, twice over."""
    s = table(spark, sf, "supplier")
    name = F.concat(F.lit("scene"), F.col("s_suppkey").cast("string"), F.lit("_"), F.col("s_nationkey").cast("string"))
    lines = s.select(F.when(F.col("s_suppkey") % 7 == 3, F.concat(F.lit("# "), name)).otherwise(name).alias("text"))
    return manifests.split_names(_filed(spark, lines, "split"), 2).withColumn("place", F.col("place").cast("long"))


@query("""SELECT p_partkey AS cell, CASE WHEN 1 - p_partkey % 256 / 255.0::DOUBLE >= 0.65 THEN 'occupied' WHEN 1 - p_partkey % 256 / 255.0::DOUBLE <= 0.196 THEN 'free' ELSE 'unknown' END AS state,
CASE WHEN p_partkey % 256 / 255.0::DOUBLE >= 0.65 THEN 'occupied' WHEN p_partkey % 256 / 255.0::DOUBLE <= 0.196 THEN 'free' ELSE 'unknown' END AS negated FROM part""")
def occupancy_map(spark, sf):
    gray = F.col("p_partkey") % 256
    return table(spark, sf, "part").select(F.col("p_partkey").alias("cell"), manifests.occupancy(gray).alias("state"), manifests.occupancy(gray, True).alias("negated"))


CLASSES = "cl AS (SELECT label AS raw, CASE WHEN label % 4 = 3 THEN NULL ELSE CAST(dense_rank() OVER (PARTITION BY label % 4 = 3 ORDER BY label) - 1 AS INT) END AS class FROM (SELECT DISTINCT label FROM embeddings))"


@query(f"WITH {CLASSES} SELECT vec_id, class AS segment, CASE WHEN class IS NOT NULL THEN vec_id % 17 END AS instance FROM embeddings JOIN cl ON raw = label")
def scene_points(spark, sf):
    """Points of a scene with classes renumbered; ignored classes have neither class nor instance."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    valid = F.col("label") % 4 != 3
    number = F.dense_rank().over(Window.partitionBy(valid).orderBy("label")) - 1  # one row a class
    classes = e.select("label").distinct().select("label", F.when(valid, number).alias("segment"))
    return e.join(classes, "label").select("vec_id", "segment", F.when(F.col("segment").isNotNull(), F.col("vec_id") % 17).alias("instance"))


@query("""WITH c AS (SELECT doc_id, source AS scene, unnest(string_split(text, '. ')) AS caption, generate_subscripts(string_split(text, '. '), 1) - 1 AS k FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY md5(doc_id || ':' || k || ':5'), doc_id, k) AS rn FROM c) SELECT scene, doc_id, CAST(k AS INT) AS k, caption FROM r WHERE rn <= 20""")
def caption_sample(spark, sf):
    """Twenty captions of each scene, without replacement, from lists of lists laid flat: the sample is the operator."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("scene"), F.posexplode(F.split("text", r"\. ")).alias("k", "caption"))
    return sampling.hashed_top(d, ["scene"], ["doc_id", "k"], 5, 20).select("scene", "doc_id", "k", "caption")


@query("""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY md5(conv_id || ':' || turn || ':9'), turn, text) AS rn FROM conversations) SELECT conv_id, turn, text FROM c WHERE rn = 1""")
def gathered_caption(spark, sf):
    """One caption of each object."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return sampling.hashed_top(c, ["conv_id"], ["conv_id", "turn"], 9, 1, ["text"]).select("conv_id", "turn", "text")


@query("SELECT p_partkey AS point_id, coalesce(r, 127.5) AS r, coalesce(g, 127.5) AS g FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN least(greatest((p_size / 60.0::DOUBLE) * 255, 0), 255) END AS r, CASE WHEN p_partkey % 5 > 0 THEN least(greatest((p_partkey % 70 / 70.0::DOUBLE) * 255, 0), 255) END AS g FROM part)")
def scaled_colours(spark, sf):
    """Colours from 0 to 1 become 0 to 255, points without one are mid-gray."""
    p = table(spark, sf, "part")
    has = F.col("p_partkey") % 5 > 0
    c = p.select(F.col("p_partkey").alias("point_id"), F.when(has, F.col("p_size") / 60.0).alias("r"), F.when(has, F.col("p_partkey") % 70 / 70.0).alias("g"))
    return whole_colours(c, ["r", "g"])


@query("SELECT CAST(p_partkey AS BIGINT) AS instance_id, p_name AS edited_label, CAST(p_size AS BIGINT) AS points, round(p_retailprice, 2) AS score FROM part WHERE p_partkey % 3 = 0")
def csv_edits(spark, sf):
    """The export of edits: fixed columns as CSV with a header, read back."""
    p = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("instance_id"), F.col("p_name").alias("edited_label"), F.col("p_size").cast("long").alias("points"), F.round("p_retailprice", 2).alias("score"))
    path = scratch(spark, "edits")
    p.write.csv(path, header=True)
    return spark.read.schema(p.schema).csv(path, header=True)


@query("SELECT CAST(p_partkey % 8 AS INT) AS chunk_id, p_partkey AS point_id, row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) - 1 AS local_idx, p_partkey % 3 = 0 AS is_core FROM part")
def chunk_files(spark, sf):
    """Chunks as partitions of Parquet files, sorted by point, read back with each point's place in its chunk."""
    p = table(spark, sf, "part").select((F.col("p_partkey") % 8).cast("int").alias("chunk_id"), F.col("p_partkey").alias("point_id"), (F.col("p_partkey") % 3 == 0).alias("is_core"))
    path = scratch(spark, "chunks")
    p.repartition("chunk_id").sortWithinPartitions("chunk_id", "point_id").write.partitionBy("chunk_id").parquet(path)
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("point_id")) - 1  # a chunk has at most its cap of points
    return spark.read.parquet(path).select("chunk_id", "point_id", place.cast("long").alias("local_idx"), "is_core")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_manifest(spark, sf):
    """A report of nested rows as JSON, read back and laid flat."""
    n = table(spark, sf, "nation")
    path = scratch(spark, "manifest")
    n.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("rooms")).write.json(path)  # a region's nations
    read = spark.read.schema("n_regionkey int, rooms array<struct<n_nationkey: int, n_name: string>>").json(path)
    return read.select("n_regionkey", F.explode("rooms").alias("r")).select("r.*", "n_regionkey")


@query("""SELECT s_nationkey AS root, arg_max(s, {'m': m, 's': s}) AS session FROM (SELECT s_nationkey, 'session_' || s_suppkey AS s, s_suppkey * 7919 % 101 AS m FROM supplier WHERE s_suppkey % 4 <> 0) GROUP BY 1""")
def latest_sessions(spark, sf):
    """The newest session of each root that has all its files."""
    s = table(spark, sf, "supplier")
    names = F.when(F.col("s_suppkey") % 4 == 0, F.array(F.lit("summary.json"))).otherwise(F.array(F.lit("summary.json"), F.lit("graph.json")))
    files = s.select(F.col("s_nationkey").alias("root"), F.concat(F.lit("session_"), F.col("s_suppkey").cast("string")).alias("session"), (F.col("s_suppkey") * 7919 % 101).alias("modified"), F.explode(names).alias("name"))
    return manifests.latest_session(files, ["summary.json", "graph.json"])


@query("""SELECT p_partkey AS chunk_id, CASE WHEN p_partkey % 6 = 0 THEN 'pending' WHEN p_partkey % 6 = 1 OR p_type <> 'x' AND p_partkey % 6 = 2 THEN 'redo' ELSE 'done' END AS state FROM part""")
def resume_states(spark, sf):
    """Which chunks a resumed batch keeps: a prediction is there, made with the same labels and the same prompts."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 6
    want = F.sha2(F.concat_ws("\n", F.lit("door"), F.lit("chair")), 256)
    made = F.when(k == 1, F.sha2(F.lit("door"), 256)).otherwise(want)
    rows = p.select(F.col("p_partkey").alias("chunk_id"), F.when(k > 0, "path").alias("prediction"), made.alias("labels"), F.when(k == 2, "old").otherwise("new").alias("prompts"))
    return rows.select("chunk_id", resume_state(F.col("prediction"), F.col("labels"), want, F.col("prompts"), F.lit("new")).alias("state"))


@query("SELECT p_partkey AS point_id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(p_size AS FLOAT) AS label, CAST(p_partkey % 7 AS FLOAT) AS instance, CAST(p_retailprice AS FLOAT) AS score FROM (SELECT *, p_size - (SELECT (min(p_size) + max(p_size)) / 2.0 FROM part) AS x, p_retailprice - (SELECT (min(p_retailprice) + max(p_retailprice)) / 2.0::DOUBLE FROM part) AS y FROM part)")
def viewer_payload(spark, sf):
    """Points as floats for a viewer: centred places, label, instance and score."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_size").alias("label"), (F.col("p_partkey") % 7).alias("instance"), F.col("p_retailprice").alias("score"))
    c = centred(p, ["x", "y"])
    return c.select("point_id", *[F.col(n).cast("float").alias(n) for n in ("x", "y", "label", "instance", "score")])
