"""Queries over clouds: embeddings' first three components are points; parts are points of a plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stoa.operators import grids, points
from stoa.operators.quantiles import quantiles
from stoa.plans.registry import query
from stoa.session import table

CLOUD = """cloud AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
 CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings)"""
PARTS = "pts AS (SELECT p_partkey AS point_id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"
ROOM = [(5.0, 950.0), (40.0, 920.0), (48.0, 1500.0), (30.0, 1300.0), (20.0, 1800.0), (3.0, 1400.0)]


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")], "label")


def plane(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


@query(f"""WITH {CLOUD}, o AS (SELECT min(x) ox, min(y) oy, min(z) oz FROM cloud),
v AS (SELECT point_id, x, y, z, row_number() OVER (PARTITION BY floor((x-ox)/0.1), floor((y-oy)/0.1), floor((z-oz)/0.1) ORDER BY point_id) rn FROM cloud, o)
SELECT point_id, x, y, z FROM v WHERE rn = 1""")
def voxel_first(spark, sf):
    return points.first_per_voxel(cloud(spark, sf).drop("label"), 0.1, from_cloud=True)


@query(f"""WITH {CLOUD}, v AS (SELECT point_id, x, y, z, row_number() OVER (PARTITION BY floor(x/0.15), floor(y/0.15), floor(z/0.15) ORDER BY point_id) rn FROM cloud)
SELECT point_id, x, y, z FROM v WHERE rn = 1""")
def voxel_first_absolute(spark, sf):
    return points.first_per_voxel(cloud(spark, sf).drop("label"), 0.15)


@query(f"""WITH {CLOUD}, v AS (SELECT point_id, row_number() OVER (PARTITION BY floor(x/0.05), floor(y/0.05) ORDER BY point_id) rn FROM cloud)
SELECT point_id FROM v WHERE rn = 1""")
def voxel_first_columns(spark, sf):
    return points.first_per_voxel(cloud(spark, sf), 0.05, ("x", "y")).select("point_id")


@query(f"""WITH {CLOUD} SELECT CAST(floor(x/0.2) AS BIGINT) vx, CAST(floor(y/0.2) AS BIGINT) vy, CAST(floor(z/0.2) AS BIGINT) vz, count(*) n,
 round(avg(x),6) mean_x, round(avg(y),6) mean_y, round(avg(z),6) mean_z FROM cloud GROUP BY 1,2,3""")
def voxel_mean_pooling(spark, sf):
    m = points.voxel_means(cloud(spark, sf), 0.2, ["x", "y", "z"])
    return m.select("vx", "vy", "vz", "n", *[F.round(f"mean_{a}", 6).alias(f"mean_{a}") for a in "xyz"])


@query(f"""WITH {CLOUD}, m AS (SELECT floor(x/0.2) vx, floor(y/0.2) vy, floor(z/0.2) vz, avg(z) mz FROM cloud GROUP BY 1,2,3)
SELECT point_id, round(mz,6) voxel_z FROM cloud JOIN m ON floor(x/0.2)=vx AND floor(y/0.2)=vy AND floor(z/0.2)=vz""")
def voxel_mean_to_points(spark, sf):
    c = cloud(spark, sf).select("point_id", "z", *points.voxel_key(0.2))
    return c.join(c.groupBy("vx", "vy", "vz").agg(F.avg("z").alias("m")), ["vx", "vy", "vz"]).select("point_id", F.round("m", 6).alias("voxel_z"))


@query(f"""WITH {CLOUD}, k AS (SELECT point_id, row_number() OVER (PARTITION BY floor(x/0.3), floor(y/0.3), floor(z/0.3) ORDER BY point_id)-1 AS r,
 count(*) OVER (PARTITION BY floor(x/0.3), floor(y/0.3), floor(z/0.3)) AS c FROM cloud), m AS (SELECT max(c) mc FROM k)
SELECT CAST(i AS BIGINT) AS part, point_id FROM k, m, range(0, 1000000) t(i) WHERE i < mc AND i % c = r""")
def grid_sample_parts(spark, sf):
    """Test-time sampling: part ``i`` takes member ``i % count`` of every voxel; as many parts as the fullest voxel has."""
    c = cloud(spark, sf).select("point_id", *points.voxel_key(0.3))
    cell = Window.partitionBy("vx", "vy", "vz")
    k = c.withColumns({"r": F.row_number().over(cell.orderBy("point_id")) - 1, "c": F.count(F.lit(1)).over(cell)})
    most = k.agg(F.max("c").alias("mc"))
    parts = k.join(F.broadcast(most)).withColumn("part", F.explode(F.expr("sequence(cast(r as long), mc - 1, c)")))
    return parts.select("part", "point_id")


@query(f"""WITH {CLOUD} SELECT label AS instance_id, count(*) points, round(avg(x),6) cx, round(avg(y),6) cy, round(avg(z),6) cz,
 min(x) x0, min(y) y0, min(z) z0, max(x) x1, max(y) y1, max(z) z1 FROM cloud GROUP BY label""")
def instance_stats(spark, sf):
    c = cloud(spark, sf)
    return c.groupBy(F.col("label").alias("instance_id")).agg(
        F.count(F.lit(1)).alias("points"), *[F.round(F.avg(a), 6).alias(f"c{a}") for a in "xyz"], *[F.min(a).alias(f"{a}0") for a in "xyz"], *[F.max(a).alias(f"{a}1") for a in "xyz"]
    )


@query(f"""WITH {CLOUD} SELECT label, CASE WHEN count(*) > 20 THEN round(quantile_cont(x, 0.02),6) ELSE round(min(x),6) END x0,
 CASE WHEN count(*) > 20 THEN round(quantile_cont(x, 0.98),6) ELSE round(max(x),6) END x1 FROM cloud GROUP BY label""")
def robust_bbox(spark, sf):
    """2nd and 98th percentiles for over 20 points, else the extremes; percentiles by narrowing histograms."""
    c = cloud(spark, sf).select("label", "x")
    q = quantiles(c, ["label"], "x", [0.02, 0.98]).groupBy("label").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    n = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    many = F.col("n") > 20
    return n.join(q, "label").select("label", F.round(F.when(many, F.col("low")).otherwise(F.col("least")), 6).alias("x0"), F.round(F.when(many, F.col("high")).otherwise(F.col("most")), 6).alias("x1"))


@query(f"WITH {PARTS} SELECT point_id FROM pts WHERE x BETWEEN 10 AND 30 AND y BETWEEN 1000 AND 1400")
def box_filter(spark, sf):
    return plane(spark, sf).where(points.in_box(F.col("x"), F.col("y"), (10, 1000, 30, 1400))).select("point_id")


@query(f"""WITH {PARTS}, boxes AS (SELECT s_suppkey AS box_id, s_suppkey % 40 AS x0, 900 + (s_suppkey * 37) % 900 AS y0 FROM supplier)
SELECT box_id, count(point_id) AS n FROM boxes LEFT JOIN pts ON x BETWEEN x0 AND x0 + 8 AND y BETWEEN y0 AND y0 + 150 GROUP BY box_id""")
def box_counts(spark, sf):
    """Points in each box: equal boxes are counted once, equal points as one, and both meet in the grid cells that a box covers."""
    boxes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("box_id"), (F.col("s_suppkey") % 40).alias("x0"), (900 + (F.col("s_suppkey") * 37) % 900).alias("y0"))
    cells = lambda a, w: F.explode(F.sequence(F.floor(F.col(a) / w), F.floor((F.col(a) + w) / w)))
    near = boxes.select("x0", "y0").distinct().withColumn("cx", cells("x0", 8)).withColumn("cy", cells("y0", 150))
    inside = F.col("x").between(F.col("x0"), F.col("x0") + 8) & F.col("y").between(F.col("y0"), F.col("y0") + 150)
    spots = plane(spark, sf).groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")).withColumns({"cx": F.floor(F.col("x") / 8), "cy": F.floor(F.col("y") / 150)})
    found = spots.join(near.hint("merge"), ["cx", "cy"]).where(inside).groupBy("x0", "y0").agg(F.sum("m").alias("n"))
    return boxes.join(found, ["x0", "y0"], "left").select("box_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _polygon_sql(viewer: bool) -> str:
    parts = []
    for (xi, yi), (xj, yj) in zip(ROOM, [ROOM[-1], *ROOM[:-1]], strict=True):
        under = f"({yj - yi}::DOUBLE + 1e-12::DOUBLE)" if viewer else f"{yj - yi}::DOUBLE"
        parts.append(f"CAST((({yi} > y) <> ({yj} > y)) AND x < {xj - xi}::DOUBLE * (y - {yi}::DOUBLE) / {under} + {xi}::DOUBLE AS INT)")
    return f"WITH {PARTS} SELECT point_id FROM pts WHERE ({' + '.join(parts)}) % 2 = 1"


@query(_polygon_sql(False))
def points_in_polygon(spark, sf):
    return plane(spark, sf).where(points.in_polygon(F.col("x"), F.col("y"), ROOM)).select("point_id")


@query(_polygon_sql(True))
def points_in_polygon_viewer(spark, sf):
    return plane(spark, sf).where(points.in_polygon(F.col("x"), F.col("y"), ROOM, viewer=True)).select("point_id")


@query(f"WITH {CLOUD} SELECT point_id FROM cloud WHERE (x-0.05)*(x-0.05) + (y+0.02)*(y+0.02) + z*z <= 0.15*0.15")
def sphere_filter(spark, sf):
    d2 = (F.col("x") - 0.05) * (F.col("x") - 0.05) + (F.col("y") + 0.02) * (F.col("y") + 0.02) + F.col("z") * F.col("z")
    return cloud(spark, sf).where(d2 <= 0.15 * 0.15).select("point_id")


@query(f"""WITH {CLOUD}, neg AS (SELECT * FROM cloud WHERE point_id IN (3, 50, 77))
SELECT point_id FROM cloud c WHERE point_id = 10 OR NOT EXISTS (SELECT 1 FROM neg n WHERE (c.x-n.x)*(c.x-n.x)+(c.y-n.y)*(c.y-n.y)+(c.z-n.z)*(c.z-n.z) <= 0.04)""")
def negative_seed_exclusion(spark, sf):
    """Points not within the radius of a negative click; the seed always stays. Clicks are few: a handful of literals."""
    c = cloud(spark, sf)
    clicks = F.broadcast(c.where(F.col("point_id").isin(3, 50, 77)).select(*[F.col(a).alias(f"n{a}") for a in "xyz"]))
    d2 = sum((F.col(a) - F.col(f"n{a}")) * (F.col(a) - F.col(f"n{a}")) for a in "xyz")
    return c.join(clicks, (d2 <= 0.04) & (F.col("point_id") != 10), "left_anti").select("point_id")


@query(f"WITH {CLOUD} SELECT point_id, greatest(least(x, 0.1), -0.1) x, greatest(least(y, 0.1), -0.1) y, greatest(least(z, 0.2), -0.2) z FROM cloud WHERE label NOT IN (0, 1)")
def crop_and_clip(spark, sf):
    clip = {"x": 0.1, "y": 0.1, "z": 0.2}
    return cloud(spark, sf).where(~F.col("label").isin(0, 1)).select("point_id", *[F.greatest(F.least(F.col(a), F.lit(m)), F.lit(-m)).alias(a) for a, m in clip.items()])


@query(f"""WITH {CLOUD}, q AS (SELECT quantile_cont(z, 0.02) f FROM cloud) SELECT point_id FROM cloud, q WHERE z BETWEEN f + 0.05 AND f + 0.3""")
def height_band(spark, sf):
    """The floor is the cloud's 2nd percentile of z; the band above it is closed."""
    c = cloud(spark, sf)
    floor = quantiles(c.select(F.lit(0).alias("all"), "z"), ["all"], "z", [0.02]).select(F.col("v").alias("f"))  # one row
    return c.join(F.broadcast(floor)).where(F.col("z").between(F.col("f") + 0.05, F.col("f") + 0.3)).select("point_id")


@query(f"""WITH {CLOUD}, m AS (SELECT (min(x)+max(x))/2 mx, (min(y)+max(y))/2 my, min(z) mz FROM cloud)
SELECT point_id, round(x-mx,6) x, round(y-my,6) y, round(z-mz,6) z FROM cloud, m""")
def centre_shift(spark, sf):
    c = cloud(spark, sf)
    m = c.agg(((F.min("x") + F.max("x")) / 2).alias("mx"), ((F.min("y") + F.max("y")) / 2).alias("my"), F.min("z").alias("mz"))
    return c.join(F.broadcast(m)).select("point_id", *[F.round(F.col(a) - F.col(f"m{a}"), 6).alias(a) for a in "xyz"])


@query(f"WITH {CLOUD} SELECT point_id, round(cos(0.3)*x - sin(0.3)*y + 1.5, 6) x, round(sin(0.3)*x + cos(0.3)*y - 0.5, 6) y FROM cloud")
def rigid_transform(spark, sf):
    s, c = F.sin(F.lit(0.3)), F.cos(F.lit(0.3))
    return cloud(spark, sf).select("point_id", F.round(c * F.col("x") - s * F.col("y") + 1.5, 6).alias("x"), F.round(s * F.col("x") + c * F.col("y") - 0.5, 6).alias("y"))


@query(f"""WITH {PARTS}, c AS (SELECT CAST(floor(x/5) AS BIGINT) AS c, CAST(floor((y-900)/50) AS BIGINT) AS r FROM pts)
SELECT r AS "row", c AS col, count(*) n FROM c GROUP BY 1,2 HAVING count(*) >= 3""")
def grid_occupancy(spark, sf):
    return grids.occupancy(plane(spark, sf), F.floor((F.col("y") - 900) / 50), F.floor(F.col("x") / 5), 3)


OCC = f"""{PARTS}, occ AS (SELECT CAST(floor((y-900)/50) AS BIGINT) AS r, CAST(floor(x/5) AS BIGINT) AS c FROM pts GROUP BY 1,2 HAVING count(*) >= 18),
d AS (SELECT DISTINCT r+i AS r, c+j AS c FROM occ, range(-1,2) a(i), range(-1,2) b(j) WHERE r+i BETWEEN 0 AND 24 AND c+j BETWEEN 0 AND 10)"""


def _occupied(spark, sf):
    return grids.occupancy(plane(spark, sf), F.floor((F.col("y") - 900) / 50), F.floor(F.col("x") / 5), 18).select("row", "col")


@query(f'WITH {OCC} SELECT r AS "row", c AS col FROM d')
def grid_dilate(spark, sf):
    return grids.dilate(_occupied(spark, sf), 1, (25, 11))




@query(f"""WITH {OCC}, e AS (SELECT o.r, o.c, count(n.r) k, (least(o.r+1,24)-greatest(o.r-1,0)+1)*(least(o.c+1,10)-greatest(o.c-1,0)+1) w
FROM occ o JOIN occ n ON n.r BETWEEN o.r-1 AND o.r+1 AND n.c BETWEEN o.c-1 AND o.c+1 GROUP BY o.r, o.c) SELECT r AS "row", c AS col FROM e WHERE k = w""")
def grid_erode(spark, sf):
    return grids.erode(_occupied(spark, sf), 1, (25, 11))


@query(f"""WITH {OCC}, e AS (SELECT o.r, o.c, count(n.r) k, (least(o.r+1,24)-greatest(o.r-1,0)+1)*(least(o.c+1,10)-greatest(o.c-1,0)+1) w
FROM d o JOIN d n ON n.r BETWEEN o.r-1 AND o.r+1 AND n.c BETWEEN o.c-1 AND o.c+1 GROUP BY o.r, o.c) SELECT r AS "row", c AS col FROM e WHERE k = w""")
def grid_close(spark, sf):
    return grids.erode(grids.dilate(_occupied(spark, sf), 1, (25, 11)), 1, (25, 11))


@query(f"""WITH RECURSIVE {OCC}, reach AS (SELECT r, c, r AS r0, c AS c0 FROM occ UNION SELECT o.r, o.c, p.r0, p.c0 FROM reach p JOIN occ o ON o.r BETWEEN p.r-1 AND p.r+1 AND o.c BETWEEN p.c-1 AND p.c+1)
SELECT r AS "row", c AS col, CAST(min(r0 * 11 + c0) AS BIGINT) AS component FROM reach GROUP BY r, c""")
def grid_components(spark, sf):
    """8-connected components, each named by its first cell in row-major order."""
    return grids.components(_occupied(spark, sf), 11)


@query(f"""WITH {PARTS}, o AS (SELECT CAST(floor((y-900)/50) AS BIGINT) AS r, CAST(floor(x/5) AS BIGINT) AS c, point_id % 3 AS k FROM pts)
SELECT 'union' AS op, count(*) n FROM (SELECT r,c FROM o WHERE k=0 UNION SELECT r,c FROM o WHERE k=1)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT r,c FROM o WHERE k=0 INTERSECT SELECT r,c FROM o WHERE k=1)
UNION ALL SELECT 'minus', count(*) FROM (SELECT r,c FROM o WHERE k=0 EXCEPT SELECT r,c FROM o WHERE k=1)""")
def mask_set_operations(spark, sf):
    o = plane(spark, sf).select(F.floor((F.col("y") - 900) / 50).alias("row"), F.floor(F.col("x") / 5).alias("col"), (F.col("point_id") % 3).alias("k"))
    a, b = (o.where(F.col("k") == k).drop("k").distinct() for k in (0, 1))
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "minus": a.subtract(b)}
    out = None
    for name, cells in made.items():
        row = cells.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {PARTS}, c AS (SELECT avg(x) mx, avg(y) my FROM pts), b AS (SELECT point_id, x, y, CAST(floor((atan2(y-my, x-mx) + pi()) / (2*pi()) * 72) AS BIGINT) AS bin, (x-mx)*(x-mx)+(y-my)*(y-my) AS d FROM pts, c),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY d DESC, point_id) rn FROM b) SELECT bin, point_id FROM r WHERE rn = 1""")
def ray_bin_polygon(spark, sf):
    """The farthest point of each of 72 directions from the centre."""
    p = plane(spark, sf)
    c = p.join(F.broadcast(p.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    b = c.select("point_id", F.floor((F.atan2(dy, dx) + F.pi()) / (2 * F.pi()) * 72).alias("bin"), (dx * dx + dy * dy).alias("d"))
    return b.groupBy("bin").agg(F.max_by("point_id", F.struct("d", -F.col("point_id"))).alias("point_id"))


@query("""WITH s AS (SELECT s_suppkey k, s_acctbal b FROM supplier) SELECT x.k AS a, y.k AS b, round(abs(x.b-y.b),6) AS gap FROM s x JOIN s y ON x.k < y.k AND abs(x.b-y.b) <= 75""")
def near_pairs(spark, sf):
    p = points.near_pairs(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal", 75.0)
    return p.select("a", "b", F.round("gap", 6).alias("gap"))


@query("""WITH s AS (SELECT s_suppkey k, s_acctbal b FROM supplier), p AS (SELECT x.k AS room, y.k AS neighbour, abs(x.b-y.b) AS gap FROM s x JOIN s y ON x.k <> y.k AND abs(x.b-y.b) <= 150),
r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY gap, neighbour) AS rank FROM p) SELECT room, neighbour, rank FROM r WHERE rank <= 6""")
def room_neighbours(spark, sf):
    """At most six nearest rooms of each within the gap; not symmetric."""
    p = points.nearest_in_line(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal", 150.0, 6)
    return p.select(F.col("item").alias("room"), F.col("other").alias("neighbour"), "rank")


@query("""WITH r AS (SELECT n_nationkey k, (n_nationkey * 7) % 50 AS x0, 900 + (n_nationkey * 211) % 900 AS y0 FROM nation), p AS (SELECT p_partkey AS point_id, CAST(p_size AS DOUBLE) x, p_retailprice y FROM part),
s AS (SELECT point_id, k, pow(greatest(x0-x, 0, x-(x0+4)),2) + pow(greatest(y0-y, 0, y-(y0+60)),2) + 1e-6*(pow(x-x0-2,2)+pow(y-y0-30,2)) AS score FROM p, r),
o AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(score,9), k) rn FROM s) SELECT point_id, k AS area FROM o WHERE rn = 1""")
def nearest_area(spark, sf):
    """The room of least squared gap to its box, centroids breaking ties; rooms are a checked small table."""
    from stoa.session import broadcast_if_small

    rooms = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") * 7) % 50).alias("x0"), (900 + (F.col("n_nationkey") * 211) % 900).alias("y0"))
    zero = F.lit(0.0)
    gx = F.greatest(F.col("x0") - F.col("x"), zero, F.col("x") - (F.col("x0") + 4))
    gy = F.greatest(F.col("y0") - F.col("y"), zero, F.col("y") - (F.col("y0") + 60))
    score = F.pow(gx, F.lit(2)) + F.pow(gy, F.lit(2)) + 1e-6 * (F.pow(F.col("x") - F.col("x0") - 2, F.lit(2)) + F.pow(F.col("y") - F.col("y0") - 30, F.lit(2)))
    pairs = plane(spark, sf).join(broadcast_if_small(rooms, 10_000))
    return pairs.groupBy("point_id").agg(F.min_by("k", F.struct(F.round(score, 9), "k")).alias("area"))


@query(f"""WITH {CLOUD} SELECT point_id, CAST((CASE WHEN floor((x+1)*500)::BIGINT & 1 > 0 THEN 4 ELSE 0 END) + (CASE WHEN floor((y+1)*500)::BIGINT & 1 > 0 THEN 2 ELSE 0 END) + (floor((z+1)*500)::BIGINT & 1)
 + list_sum(list_transform(range(1,16), lambda i: ((((floor((x+1)*500)::BIGINT >> i) & 1) << (3*i+2)) | (((floor((y+1)*500)::BIGINT >> i) & 1) << (3*i+1)) | (((floor((z+1)*500)::BIGINT >> i) & 1) << (3*i))))) AS BIGINT) AS code FROM cloud""")
def morton_codes(spark, sf):
    from stoa.functions.codes import morton

    return cloud(spark, sf).select("point_id", morton(*[F.floor((F.col(a) + 1) * 500) for a in "xyz"]).alias("code"))


@query(f"""WITH {CLOUD}, s AS (SELECT label, point_id, md5(concat_ws(':', CAST(point_id AS VARCHAR), '17')) h FROM cloud), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, point_id) rn FROM s) SELECT label, point_id FROM r WHERE rn <= 7""")
def stratified_sample(spark, sf):
    return points.exact_sample(cloud(spark, sf), "point_id", 7, 17, ["label"]).select("label", "point_id")


@query(f"""WITH {CLOUD} SELECT point_id FROM cloud ORDER BY CASE WHEN label = 3 THEN 0 ELSE 1 END, md5(concat_ws(':', CAST(point_id AS VARCHAR), '5')), point_id LIMIT 120""")
def sample_keeping_core(spark, sf):
    """Core rows first, the rest by hash order, up to a number that is the operator's parameter."""
    return points.exact_sample(cloud(spark, sf), "point_id", 120, 5, first=F.col("label") == 3).select("point_id")


@query(f"""WITH {CLOUD}, c AS (SELECT x cx, y cy, z cz FROM cloud WHERE point_id = 42), d AS (SELECT point_id, (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz) d2 FROM cloud, c)
SELECT point_id FROM d ORDER BY d2, point_id LIMIT 50""")
def sphere_crop(spark, sf):
    c = cloud(spark, sf)
    centre = F.broadcast(c.where("point_id = 42").select(*[F.col(a).alias(f"c{a}") for a in "xyz"]))
    d2 = sum((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz")
    return c.join(centre).select("point_id", d2.alias("d2")).orderBy("d2", "point_id").limit(50).select("point_id")
