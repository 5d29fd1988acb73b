"""Queries over codes, samples and transforms: embeddings' first parts are points, quantised to a cube of cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoa.functions import codes, colours, shapes
from stoa.operators import relations, sampling
from stoa.plans.clouds import CLOUD, cloud
from stoa.plans.registry import query
from stoa.session import table, written

CELLS = f"{CLOUD}, cc AS (SELECT point_id, CAST(floor((x + 1) * 511) AS BIGINT) AS x, CAST(floor((y + 1) * 511) AS BIGINT) AS y, CAST(floor((z + 1) * 511) AS BIGINT) AS z FROM cloud)"


def cells(spark, sf):
    return cloud(spark, sf).select("point_id", *[F.floor((F.col(a) + 1) * 511).alias(a) for a in "xyz"])


@query(f"WITH {CELLS} SELECT point_id, x, y, z, x AS x2, y AS y2, z AS z2 FROM cc")
def morton_round_trip(spark, sf):
    """Morton codes taken apart again give the cells that they were made of."""
    c = cells(spark, sf).withColumn("code", codes.morton(F.col("x"), F.col("y"), F.col("z")))
    return c.select("point_id", "x", "y", "z", *[v.alias(f"{a}2") for a, v in zip("xyz", codes.unmorton(F.col("code")), strict=True)])


@query(f"""WITH RECURSIVE {CELLS}, st(point_id, k, x, y, z) AS (SELECT point_id, 0, x, y, z FROM cc UNION ALL
SELECT point_id, k + 1, CASE WHEN (own & q) <> 0 THEN xor(x, q - 1) ELSE xor(x, xor(x, own) & (q - 1)) END, CASE WHEN d = 1 AND (own & q) = 0 THEN xor(y, xor(x, own) & (q - 1)) ELSE y END, CASE WHEN d = 2 AND (own & q) = 0 THEN xor(z, xor(x, own) & (q - 1)) ELSE z END
FROM (SELECT *, k % 3 AS d, CAST(1 AS BIGINT) << (9 - k // 3) AS q, CASE k % 3 WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS own FROM st WHERE k < 27)),
gr AS (SELECT point_id, list_reduce(list_transform(range(0, 10), lambda i: (((x >> i) & 1) << (3*i+2)) + (((y >> i) & 1) << (3*i+1)) + (((z >> i) & 1) << (3*i))), lambda a, b: a + b) AS g FROM st WHERE k = 27),
bn AS (SELECT point_id, list_reduce(list_transform(range(0, 30), lambda i: CAST(bit_count((g >> i)) % 2 AS BIGINT) << i), lambda a, b: a + b) AS code FROM gr) SELECT point_id, CAST(code AS BIGINT) AS code FROM bn""")
def hilbert_codes(spark, sf):
    return cells(spark, sf).select("point_id", codes.hilbert(F.col("x"), F.col("y"), F.col("z")).alias("code"))


@query(f"WITH {CELLS} SELECT point_id, x, y, z FROM cc")
def hilbert_round_trip(spark, sf):
    c = cells(spark, sf).select("point_id", codes.unhilbert(codes.hilbert(F.col("x"), F.col("y"), F.col("z"))).alias("s"))
    return c.select("point_id", "s.*")


@query(f"""WITH {CELLS}, m AS (SELECT point_id, list_reduce(list_transform(range(0, 16), lambda i: (((y >> i) & 1) << (3*i+2)) + (((x >> i) & 1) << (3*i+1)) + (((z >> i) & 1) << (3*i))), lambda a, b: a + b) AS code FROM cc) SELECT point_id, CAST(code AS BIGINT) AS code FROM m""")
def morton_swapped(spark, sf):
    """The trans order: x and y change places before the code is made."""
    return cells(spark, sf).select("point_id", codes.morton(F.col("y"), F.col("x"), F.col("z")).alias("code"))


@query(f"WITH {CELLS}, b AS (SELECT min(x) x0, min(y) y0, min(z) z0, max(y) - min(y) + 1 AS ny, max(z) - min(z) + 1 AS nz FROM cc) SELECT point_id, CAST(((x - x0) * ny + y - y0) * nz + z - z0 AS BIGINT) AS key FROM cc, b")
def ravelled_keys(spark, sf):
    """Cells as one number: the mixed radix of their places in the cloud's extent."""
    c = cells(spark, sf)
    b = c.agg(*[F.min(a).alias(f"lo_{a}") for a in "xyz"], *[(F.max(a) - F.min(a) + 1).alias(f"n_{a}") for a in "xyz"])  # one row
    key = ((F.col("x") - F.col("lo_x")) * F.col("n_y") + F.col("y") - F.col("lo_y")) * F.col("n_z") + F.col("z") - F.col("lo_z")
    return c.crossJoin(F.broadcast(b)).select("point_id", key.alias("key"))


@query(f"""WITH {CELLS}, a AS (SELECT point_id, y, z, xor(CAST((14695981039346656037::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT AS UBIGINT), CAST(x AS UBIGINT)) AS h FROM cc),
b AS (SELECT point_id, z, xor(CAST((h::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT AS UBIGINT), CAST(y AS UBIGINT)) AS h FROM a),
c AS (SELECT point_id, xor(CAST((h::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT AS UBIGINT), CAST(z AS UBIGINT)) AS h FROM b) SELECT point_id, lpad(hex(h), 16, '0') AS key FROM c""")
def fnv_keys(spark, sf):
    return cells(spark, sf).select("point_id", F.lpad(F.hex(codes.fnv([F.col("x"), F.col("y"), F.col("z")])), 16, "0").alias("key"))


QUADS = """qd AS (SELECT p_partkey AS id, p_partkey // 1000 * 60 + (p_partkey * 37 % 500) / 10.0::DOUBLE AS x, (p_partkey * 53 % 500) / 10.0::DOUBLE AS y, 1 + p_partkey % 5 / 5.0::DOUBLE AS w, (p_partkey % 3) / 4.0::DOUBLE AS t FROM part),
co AS (SELECT id, unnest([1,2,3,4]) AS k, unnest([x, x + w, x + w + t, x + t]) AS px, unnest([y, y + t, y + w + t, y + w]) AS py FROM qd), sg AS (SELECT a.id, a.k, a.px AS ax, a.py AS ay, b.px AS ex, b.py AS ey FROM co a JOIN co b ON a.id = b.id AND b.k = a.k % 4 + 1),
bb AS (SELECT id, min(px) x0, max(px) x1, min(py) y0, max(py) y1 FROM co GROUP BY 1)"""
TOSEG = "sqrt(pow({p}x - {a}x - greatest(0, least(1, (({p}x-{a}x)*({b}x-{a}x) + ({p}y-{a}y)*({b}y-{a}y)) / (pow({b}x-{a}x,2)+pow({b}y-{a}y,2)))) * ({b}x-{a}x), 2) + pow({p}y - {a}y - greatest(0, least(1, (({p}x-{a}x)*({b}x-{a}x) + ({p}y-{a}y)*({b}y-{a}y)) / (pow({b}x-{a}x,2)+pow({b}y-{a}y,2)))) * ({b}y-{a}y), 2))"
ORI = "(({b}x-{a}x)*({c}y-{a}y) - ({b}y-{a}y)*({c}x-{a}x))"


def quads(spark, sf):
    k = F.col("p_partkey")
    q = table(spark, sf, "part").select(k.alias("id"), (F.floor(k / 1000) * 60 + k * 37 % 500 / 10.0).alias("x"), (k * 53 % 500 / 10.0).alias("y"), (1 + k % 5 / 5.0).alias("w"), (k % 3 / 4.0).alias("t"))
    x, y, w, t = (F.col(c) for c in "xywt")
    poly = F.array(F.array(x, y), F.array(x + w, y + t), F.array(x + w + t, y + w + t), F.array(x + t, y + w))
    q = q.select("id", poly.alias("polygon"))
    axis = lambda k, f: f(F.transform("polygon", lambda p: p[k]))
    return q.withColumns({"x0": axis(0, F.array_min), "x1": axis(0, F.array_max), "y0": axis(1, F.array_min), "y1": axis(1, F.array_max)})


@query(f"""WITH {QUADS}, cd AS (SELECT a.id AS ia, b.id AS ib FROM bb a JOIN bb b ON a.id < b.id AND sqrt(pow(greatest(a.x0-b.x1,b.x0-a.x1,0),2)+pow(greatest(a.y0-b.y1,b.y0-a.y1,0),2)) <= 0.5),
ss AS (SELECT ia, ib, s.ax AS ax, s.ay AS ay, s.ex AS ex, s.ey AS ey, u.ax AS cx, u.ay AS cy, u.ex AS dx, u.ey AS dy FROM cd JOIN sg s ON s.id = ia JOIN sg u ON u.id = ib),
ds AS (SELECT ia, ib, CASE WHEN {ORI.format(a='a', b='e', c='c')} * {ORI.format(a='a', b='e', c='d')} < 0 AND {ORI.format(a='c', b='d', c='a')} * {ORI.format(a='c', b='d', c='e')} < 0 THEN 0 ELSE least({TOSEG.format(p='a', a='c', b='d')}, {TOSEG.format(p='e', a='c', b='d')}, {TOSEG.format(p='c', a='a', b='e')}, {TOSEG.format(p='d', a='a', b='e')}) END AS d FROM ss),
mn AS (SELECT ia, ib, min(d) AS d FROM ds GROUP BY 1, 2) SELECT ia AS a, ib AS b, round(CASE WHEN d < 1e-7 THEN 0 ELSE d END, 6) AS distance FROM mn WHERE d <= 0.5""")
def polygon_neighbours(spark, sf):
    """Rooms whose outlines come within half a metre: boxes first, then their sides."""
    q = quads(spark, sf).withColumn("sides", shapes.segments(F.col("polygon"))).drop("polygon")
    q = written(q, "quads")  # else each step's filters make boxes and sides anew
    p = relations.box_pairs(q, "id", 0.5).select("a_id", "b_id", F.explode("a_sides").alias("s"), "b_sides")
    p = p.select("a_id", "b_id", "s", F.explode("b_sides").alias("u")).where(shapes.segments_meet(F.col("s"), F.col("u"), 0.5))
    p = p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), shapes.side_distance(F.col("s"), F.col("u")).alias("d"))
    near = p.groupBy("a", "b").agg(F.min("d").alias("d")).where("d <= 0.5")
    return near.select("a", "b", F.round(F.when(F.col("d") < 1e-7, 0.0).otherwise(F.col("d")), 6).alias("distance"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 3 > 0 THEN p_size * 1.5::DOUBLE END AS x FROM part""")
def geometry_coerced(spark, sf):
    """Lists of text as two finite numbers, or nothing: lengths and spellings that don't fit give null."""
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.array((F.col("p_size") * 1.5).cast("string"))).otherwise(F.array((F.col("p_size") * 1.5).cast("string"), F.when(k % 3 == 0, "inf").otherwise("0")))
    return table(spark, sf, "part").select(k.alias("id"), shapes.finite_list(raw, 2)[0].alias("x"))


@query("""SELECT CAST(id AS INT) AS id, CAST(floor(CASE six % 6 WHEN 0 THEN 0.95 WHEN 1 THEN q WHEN 2 THEN 0.3325 WHEN 3 THEN 0.3325 WHEN 4 THEN t ELSE 0.95 END * 255 + 1e-9) AS INT) AS r, CAST(floor(CASE six % 6 WHEN 0 THEN t WHEN 1 THEN 0.95 WHEN 2 THEN 0.95 WHEN 3 THEN q WHEN 4 THEN 0.3325 ELSE 0.3325 END * 255 + 1e-9) AS INT) AS g, CAST(floor(CASE six % 6 WHEN 0 THEN 0.3325 WHEN 1 THEN 0.3325 WHEN 2 THEN t WHEN 3 THEN 0.95 WHEN 4 THEN 0.95 ELSE q END * 255 + 1e-9) AS INT) AS b
FROM (SELECT id, six, 0.95::DOUBLE * (1 - 0.65::DOUBLE * (h * 6 - six)) AS q, 0.95::DOUBLE * (1 - 0.65::DOUBLE * (1 - (h * 6 - six))) AS t FROM (SELECT id, h, CAST(floor(h * 6) AS BIGINT) AS six FROM (SELECT p_partkey AS id, p_partkey * 0.618033988749895::DOUBLE - floor(p_partkey * 0.618033988749895::DOUBLE) AS h FROM part)))""")
def label_palette(spark, sf):
    """Colours of labels: hues by the golden ratio."""
    r, g, b = colours.palette(F.col("p_partkey"))
    return table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("id"), r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT p_partkey AS id, round(0.299*r + 0.587*g + 0.114*b, 6) AS gray, round(least(greatest(0.7*r + 0.3*(0.299*r + 0.587*g + 0.114*b), 0), 255), 6) AS duller, round(least(greatest(1.4*r, 0), 255), 6) AS brighter FROM (SELECT p_partkey, p_size * 5.0::DOUBLE AS r, p_partkey % 256 * 1.0::DOUBLE AS g, p_partkey * 7 % 256 * 1.0::DOUBLE AS b FROM part)")
def colour_jitter(spark, sf):
    """Gray, less saturated and brighter colours."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("id"), (F.col("p_size") * 5.0).alias("r"), (k % 256 * 1.0).alias("g"), (k * 7 % 256 * 1.0).alias("b"))
    gray = colours.gray(F.col("r"), F.col("g"), F.col("b"))
    return p.select("id", F.round(gray, 6).alias("gray"), F.round(colours.blend(F.col("r"), gray, 0.7), 6).alias("duller"), F.round(colours.blend(F.col("r"), F.lit(0.0), 1.4), 6).alias("brighter"))


DRAWS = "md5(concat_ws(':', {k}, '{s}'))"


@query(f"""WITH {CLOUD}, v AS (SELECT point_id, row_number() OVER (PARTITION BY floor(x/0.2), floor(y/0.2), floor(z/0.2) ORDER BY {DRAWS.format(k='point_id', s=4)}, point_id) AS rn FROM cloud) SELECT point_id FROM v WHERE rn = 1""")
def grid_sample_random(spark, sf):
    """One random member of every voxel."""
    voxel = [F.floor(F.col(a) / 0.2).alias(f"v{a}") for a in "xyz"]
    return sampling.hashed_top(cloud(spark, sf).select("point_id", *voxel), ["vx", "vy", "vz"], ["point_id"], 4, 1).select("point_id")


@query(f"WITH s AS (SELECT p_partkey, row_number() OVER (ORDER BY {DRAWS.format(k='p_partkey', s=8)}, p_partkey) AS rn FROM part) SELECT p_partkey FROM s WHERE rn <= 150")
def uniform_sample(spark, sf):
    """A hundred and fifty points without replacement, in their order."""
    p = table(spark, sf, "part").select("p_partkey")
    return p.withColumn("_d", sampling.draw(["p_partkey"], 8)).orderBy("_d", "p_partkey").limit(150).select("p_partkey").orderBy("p_partkey")


@query(f"SELECT l_orderkey, l_partkey FROM lineitem WHERE {DRAWS.format(k='l_orderkey, l_partkey', s=3)} < '40000000000000000000000000000000'")
def bernoulli_sample(spark, sf):
    """A quarter of the rows, each by its own draw."""
    return table(spark, sf, "lineitem").where(sampling.share(["l_orderkey", "l_partkey"], 3) < 0.25).select("l_orderkey", "l_partkey")


@query(f"WITH d AS (SELECT vec_id, label, vec_id % 50 = 0 AS forced, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN vec_id % 50 = 0 THEN 0 ELSE 1 END, {DRAWS.format(k='vec_id', s=6)}, vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id FROM d WHERE forced OR rn <= floor(n * 0.8)")
def random_dropout(spark, sf):
    """Four fifths of each scene's points; those that were sampled before stay."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 50 == 0).alias("forced"))
    order = Window.partitionBy("label").orderBy(F.desc(F.col("forced").cast("int")), sampling.draw(["vec_id"], 6), "vec_id")
    d = e.withColumns({"rn": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("label"))})
    return d.where(F.col("forced") | (F.col("rn") <= F.floor(F.col("n") * 0.8))).select("vec_id")


@query(f"SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY {DRAWS.format(k='vec_id', s=12)}, vec_id) - 1 AS place FROM embeddings")
def shuffled_points(spark, sf):
    """A permutation of each scene's points."""
    order = Window.partitionBy("label").orderBy(sampling.draw(["vec_id"], 12), "vec_id")
    return table(spark, sf, "embeddings").select("vec_id", (F.row_number().over(order) - 1).cast("long").alias("place"))


@query(f"WITH {CLOUD}, c AS (SELECT x AS cx, y AS cy, z AS cz FROM cloud WHERE point_id = (SELECT arg_min(point_id, {DRAWS.format(k='point_id', s=2)}) FROM cloud)), r AS (SELECT point_id, row_number() OVER (ORDER BY round((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz), 12), point_id) AS rn FROM cloud, c) SELECT point_id FROM r WHERE rn <= 80")
def random_sphere_crop(spark, sf):
    """The eighty points nearest to a random one: the crop's size is the operator's."""
    c = cloud(spark, sf)
    centre = c.agg(F.min_by(F.struct("x", "y", "z"), F.struct(sampling.draw(["point_id"], 2), "point_id")).alias("c"))  # one row
    d2 = sum((F.col(a) - F.col(f"c.{a}")) * (F.col(a) - F.col(f"c.{a}")) for a in "xyz")
    return c.crossJoin(F.broadcast(centre)).withColumn("d", F.round(d2, 12)).orderBy("d", "point_id").limit(80).select("point_id")


@query(f"WITH {CLOUD} SELECT label, arg_min(point_id, {{'d': round((x-0.05)*(x-0.05)+(y-0.02)*(y-0.02)+z*z, 12), 'i': point_id}}) AS point_id FROM cloud GROUP BY 1")
def nearest_point(spark, sf):
    """Of each scene the point nearest to a place."""
    d = F.round((F.col("x") - 0.05) * (F.col("x") - 0.05) + (F.col("y") - 0.02) * (F.col("y") - 0.02) + F.col("z") * F.col("z"), 12)
    return cloud(spark, sf).groupBy("label").agg(F.min_by("point_id", F.struct(d, "point_id")).alias("point_id"))


@query(f"""WITH {CLOUD}, a AS (SELECT label, CAST(('0x' || substr({DRAWS.format(k='label', s=1)}, 1, 8)) AS UBIGINT) / 4294967296.0 * 2 * pi() AS t FROM (SELECT DISTINCT label FROM cloud)), m AS (SELECT label, (min(x)+max(x))/2 AS mx, (min(y)+max(y))/2 AS my FROM cloud GROUP BY 1)
SELECT point_id, round(cos(t)*(x-mx) - sin(t)*(y-my) + mx, 6) AS x, round(sin(t)*(x-mx) + cos(t)*(y-my) + my, 6) AS y, round(z * 1.1, 6) AS z FROM cloud JOIN a USING (label) JOIN m USING (label)""")
def scene_rotation(spark, sf):
    """Each scene turned around its middle by an angle of its own draw, and scaled in height."""
    c = cloud(spark, sf)
    own = c.groupBy("label").agg(((F.min("x") + F.max("x")) / 2).alias("mx"), ((F.min("y") + F.max("y")) / 2).alias("my")).withColumn("t", sampling.share(["label"], 1) * 2 * F.pi())
    x, y, s, k = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.sin("t"), F.cos("t")
    return c.join(own, "label").select("point_id", F.round(k * x - s * y + F.col("mx"), 6).alias("x"), F.round(s * x + k * y + F.col("my"), 6).alias("y"), F.round(F.col("z") * 1.1, 6).alias("z"))


@query(f"WITH {CLOUD}, d AS (SELECT *, CAST(('0x' || substr({DRAWS.format(k='point_id', s=31)}, 1, 8)) AS UBIGINT) / 4294967296.0 AS u FROM cloud) SELECT point_id, round(x + least(greatest((u - 0.5) * 0.2, -0.05), 0.05), 6) AS view1_x, round(-x + least(greatest((u - 0.5) * 0.2, -0.05), 0.05), 6) AS view2_x FROM d")
def two_views(spark, sf):
    """Two views of every point: clipped jitter, and the same mirrored."""
    shift = F.least(F.greatest((sampling.share(["point_id"], 31) - 0.5) * 0.2, F.lit(-0.05)), F.lit(0.05))
    return cloud(spark, sf).select("point_id", F.round(F.col("x") + shift, 6).alias("view1_x"), F.round(-F.col("x") + shift, 6).alias("view2_x"))


@query(f"""WITH {CLOUD}, n AS (SELECT label, count(*) AS n FROM cloud GROUP BY 1), o AS (SELECT label, n, sum(n) OVER (ORDER BY label) AS ends, row_number() OVER (ORDER BY label) - 1 AS b FROM n), p AS (SELECT label, point_id, row_number() OVER (PARTITION BY label ORDER BY point_id) - 1 AS k FROM cloud)
SELECT point_id, CAST(ends - n + k AS BIGINT) AS place, b AS batch FROM p JOIN o USING (label)""")
def collated_scenes(spark, sf):
    """Scenes laid end to end: each point's place in the batch and its scene's number. Offsets are one row a scene."""
    c = cloud(spark, sf).select("label", "point_id")
    n = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    scenes = Window.orderBy("label")
    o = n.select("label", (F.sum("n").over(scenes) - F.col("n")).alias("start"), (F.row_number().over(scenes) - 1).cast("long").alias("batch"))
    k = F.row_number().over(Window.partitionBy("label").orderBy("point_id")) - 1
    return c.withColumn("k", k).join(o, "label").select("point_id", (F.col("start") + F.col("k")).alias("place"), "batch")


@query("""WITH p AS (SELECT vec_id, label, vec_id % 4 <> 1 AS main FROM embeddings), r AS (SELECT vec_id, main, row_number() OVER (PARTITION BY main ORDER BY vec_id) - 1 AS k FROM p) SELECT vec_id, CASE WHEN main THEN k // 3 ELSE k END AS batch FROM r WHERE main OR k < (SELECT ceil(count(*) / 3.0) FROM p WHERE main)""")
def interleaved_batches(spark, sf):
    """Batches of two sets in a ratio of three to one; the main set's length decides how many there are."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 4 != 1).alias("main"))
    k = F.row_number().over(Window.partitionBy("main").orderBy("vec_id")) - 1
    n = e.where("main").agg(F.ceil(F.count(F.lit(1)) / 3.0).alias("n"))  # one row
    r = e.withColumn("k", k).crossJoin(F.broadcast(n)).where(F.col("main") | (F.col("k") < F.col("n")))
    return r.select("vec_id", F.when(F.col("main"), F.floor(F.col("k") / 3)).otherwise(F.col("k")).cast("long").alias("batch"))


@query("""WITH s AS (SELECT l_suppkey, l_partkey, lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber, l_extendedprice) AS before FROM lineitem),
g AS (SELECT l_suppkey, l_partkey, CASE WHEN before IS NULL OR before <> l_partkey THEN 1 ELSE 0 END AS starts FROM s) SELECT l_suppkey, CAST(sum(starts) AS BIGINT) AS segments, count(*) AS n FROM g GROUP BY 1""")
def sorted_segments(spark, sf):
    """Segments of equal ids in sorted order: where each begins, by the change from the row before."""
    order = Window.partitionBy("l_suppkey").orderBy("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    s = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", F.lag("l_partkey").over(order).alias("before"))
    starts = F.when(F.col("before").isNull() | (F.col("before") != F.col("l_partkey")), 1).otherwise(0)
    return s.groupBy("l_suppkey").agg(F.sum(starts).alias("segments"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CLOUD}, p AS (SELECT point_id, x * 0.8 - y * 0.6 AS u, x * 0.6 + y * 0.8 AS v, z + 2.0 AS d, 2.0 + (point_id % 7 - 3) * 0.15 AS depth FROM cloud), q AS (SELECT *, CAST(trunc(u * 500 / d + 320 + 0.5) AS INT) AS px, CAST(trunc(v * 500 / d + 240 + 0.5) AS INT) AS py FROM p)
SELECT point_id, px, py FROM q WHERE px >= 0 AND px < 640 AND py >= 0 AND py < 480 AND d >= 0 AND depth <> 0 AND abs(depth - d) <= 0.2 * depth""")
def projected_points(spark, sf):
    """Points in a camera's picture that its depth doesn't hide."""
    c = cloud(spark, sf)
    p = c.select("point_id", (F.col("x") * 0.8 - F.col("y") * 0.6).alias("u"), (F.col("x") * 0.6 + F.col("y") * 0.8).alias("v"), (F.col("z") + 2.0).alias("d"), (2.0 + (F.col("point_id") % 7 - 3) * 0.15).alias("depth"))
    pixel = lambda a, c: (F.col(a) * 500 / F.col("d") + c + 0.5).cast("int")
    q = p.withColumns({"px": pixel("u", 320), "py": pixel("v", 240)})
    seen = F.col("px").between(0, 639) & F.col("py").between(0, 479) & (F.col("d") >= 0) & (F.col("depth") != 0) & (F.abs(F.col("depth") - F.col("d")) <= 0.2 * F.col("depth"))
    return q.where(seen).select("point_id", "px", "py")


@query(f"""WITH {CLOUD}, i AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS instance, round((min(x)+max(x))/2, 6) AS cx, round(max(x)-min(x), 6) AS sx, round(max(z)-min(z), 6) AS sz, count(*) AS n FROM cloud WHERE label % 4 <> 3 GROUP BY label) SELECT point_id, instance, cx, sx, sz, n FROM cloud JOIN i USING (label)""")
def parsed_instances(spark, sf):
    """Instances renumbered densely, with centre, size and number; every point gets its own. One row an instance is ranked."""
    c = cloud(spark, sf)
    i = c.where("label % 4 <> 3").groupBy("label").agg(F.round((F.min("x") + F.max("x")) / 2, 6).alias("cx"), F.round(F.max("x") - F.min("x"), 6).alias("sx"), F.round(F.max("z") - F.min("z"), 6).alias("sz"), F.count(F.lit(1)).alias("n"))
    i = i.withColumn("instance", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))
    return c.join(i, "label").select("point_id", "instance", "cx", "sx", "sz", "n")


@query(f"WITH {CLOUD} SELECT point_id, x, z, 'floor' AS source FROM cloud WHERE label < 5 UNION ALL SELECT p_partkey, p_size / 50.0::DOUBLE, 0, 'overlay' FROM part")
def overlaid_cloud(spark, sf):
    """A transformed cloud with an overlay appended."""
    c = cloud(spark, sf).where("label < 5").select("point_id", "x", "z", F.lit("floor").alias("source"))
    return c.unionByName(table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_size") / 50.0).alias("x"), F.lit(0.0).alias("z"), F.lit("overlay").alias("source")))


def _noise_sql(a: str, seed: int) -> str:
    part = lambda at: f"CAST('0x' || substr({DRAWS.format(k='scene, i, j, k', s=seed)}, {at}, 8) AS BIGINT)"
    return f"sqrt(-2 * ln(({part(1)} + 1) / 4294967296.0::DOUBLE)) * cos(2 * pi() * {part(9)} / 4294967296.0::DOUBLE) AS d{a}"


def _elastic_sql(k: int, granularity: float, magnitude: float, seed: int) -> str:
    """Points ``c{k}`` moved to ``c{k + 1}``: a whole lattice a scene, means of three along each axis twice, eight corners."""
    ends = ", ".join(f"min({a}) AS l{a}, CAST(floor((max({a}) - min({a})) / {granularity}) AS BIGINT) + 3 AS n{a}" for a in "xyz")
    out = [f"e{k} AS (SELECT scene, {ends} FROM c{k} GROUP BY 1)", f"g{k} AS (SELECT scene, nx, ny, nz, i, j, k FROM e{k}, LATERAL (SELECT unnest(range(nx)) AS i) a, LATERAL (SELECT unnest(range(ny)) AS j) b, LATERAL (SELECT unnest(range(nz)) AS k) d)"]
    out.append(f"m{k}_0 AS (SELECT *, {', '.join(_noise_sql(a, 3 * seed + n) for n, a in enumerate('xyz'))} FROM g{k})")
    for n, (v, size) in enumerate(zip("ijk", ("nx", "ny", "nz"), strict=True)):
        same = " AND ".join(f"a.{w} = b.{w}" for w in "ijk" if w != v)
        weight = f"greatest(least(least(a.{v}, b.{v}) + 1, a.{size} - 1) - greatest(greatest(a.{v}, b.{v}) - 1, 0) + 1, 0) / 9.0::DOUBLE"
        out.append(f"m{k}_{n + 1} AS (SELECT a.scene, a.i, a.j, a.k, any_value(a.nx) AS nx, any_value(a.ny) AS ny, any_value(a.nz) AS nz, {', '.join(f'sum({weight} * b.d{a}) AS d{a}' for a in 'xyz')} FROM m{k}_{n} a JOIN m{k}_{n} b ON a.scene = b.scene AND {same} AND abs(a.{v} - b.{v}) <= 2 GROUP BY 1, 2, 3, 4)")
    out.append(f"u{k} AS (SELECT point_id, scene, {', '.join(f'{a}, ({a} - l{a}) / {granularity} + 1 AS u{a}' for a in 'xyz')} FROM c{k} JOIN e{k} USING (scene))")
    lies = " AND ".join(f"m.{v} BETWEEN CAST(floor(u{a}) AS BIGINT) AND CAST(floor(u{a}) AS BIGINT) + 1" for v, a in zip("ijk", "xyz", strict=True))
    share = " * ".join(f"(1 - abs(u{a} - m.{v}))" for v, a in zip("ijk", "xyz", strict=True))
    out.append(f"c{k + 1} AS (SELECT point_id, u.scene, {', '.join(f'any_value({a}) + {magnitude} * sum({share} * d{a}) AS {a}' for a in 'xyz')} FROM u{k} u JOIN m{k}_3 m ON m.scene = u.scene AND {lies} GROUP BY 1, 2)")
    return ", ".join(out)


ELASTIC = ((0.1, 0.02), (0.25, 0.08))


@query(f"""WITH c0 AS (SELECT vec_id AS point_id, label AS scene, {', '.join(f'CAST(embedding[{k + 1}] AS DOUBLE) AS {a}' for k, a in enumerate('xyz'))} FROM embeddings), {', '.join(_elastic_sql(k, g, m, 7 + k + 1) for k, (g, m) in enumerate(ELASTIC))}
SELECT point_id, {', '.join(f"round(CASE WHEN {DRAWS.format(k='c0.scene', s=7)} < 'f3333333' THEN c2.{a} ELSE c0.{a} END, 6) AS {a}" for a in 'xyz')} FROM c0 JOIN c2 USING (point_id)""")
def elastic_distortion(spark, sf):
    """Scenes bent by smooth noise, finely and then coarsely, nineteen of twenty."""
    from stoa.operators import distortion

    e = cloud(spark, sf).withColumnRenamed("label", "scene")
    return distortion.elastic(e, "scene", ELASTIC, 0.95, 7).select("point_id", *[F.round(a, 6).alias(a) for a in "xyz"])
