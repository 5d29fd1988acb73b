"""Queries over poses: line items are a wall band, parts the pixels of a distance field, suppliers known objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoa.operators import poses
from stoa.plans.registry import query
from stoa.session import table

POSES = [(0.0, 0.0, 0.0), (0.5, 1.0, 0.1), (4.0, 9.0, 1.5), (-2.0, 3.0, -0.3), (30.0, 0.0, 0.0), (8.0, 18.0, 3.1), (1.0, -6.0, 0.02)]
PENALTY, WEIGHT = 2.0, 0.25


def guides(spark, sf, thinned=False):
    k, li, s = F.col("p_partkey") - 1, table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    part = table(spark, sf, "part")
    height = part.count() // 10
    pixels = part.select(F.floor(k / 10).alias("row"), (k % 10).alias("col"), (F.col("p_size") / 50.0).alias("d"))
    near = part.select(F.floor(k / 10).alias("row"), (k % 10).alias("col"), ((F.col("p_size") * 7 % 50) / 50.0).alias("d"))
    band = li.select((F.col("l_quantity") / 6.0).alias("x"), ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 1000 / 1000.0 * 18).alias("y"))
    if thinned:
        square = [F.floor(F.col("x") * 10).alias("i"), F.floor(F.col("y") * 10).alias("j")]
        band = band.groupBy(*square).agg(F.round(F.avg("x"), 9).alias("x"), F.round(F.avg("y"), 9).alias("y"))
    known = s.select((F.col("s_suppkey") * 37 % 90 / 10.0).alias("x"), (F.col("s_suppkey") * 53 % 180 / 10.0).alias("y"))
    shape = (height, 10, 1.0, (0.0, 0.0), PENALTY)
    return poses.wall_guide(band, pixels, *shape), poses.object_guide(known, near, *shape)


def _cost_sql(name: str, points: str, field: str, outside: float, least: int, share: float, unfit: float) -> str:
    return f"""{name}t AS (SELECT pose, (h - 1) - (x * sin(yaw) + y * cos(yaw) + ty) AS rr, x * cos(yaw) - y * sin(yaw) + tx AS cc, h FROM {points}, po, hh),
{name}v AS (SELECT pose, CAST(floor(rr) AS BIGINT) AS r, CAST(floor(cc) AS BIGINT) AS c, rr - floor(rr) AS fr, cc - floor(cc) AS fc FROM {name}t WHERE rr >= 0 AND rr < h - 1 AND cc >= 0 AND cc < 9),
{name}d AS (SELECT pose, (a.d * (1 - fc) + b.d * fc) * (1 - fr) + (e.d * (1 - fc) + g.d * fc) * fr AS d FROM {name}v JOIN {field} a ON a.r = {name}v.r AND a.c = {name}v.c JOIN {field} b ON b.r = {name}v.r AND b.c = {name}v.c + 1 JOIN {field} e ON e.r = {name}v.r + 1 AND e.c = {name}v.c JOIN {field} g ON g.r = {name}v.r + 1 AND g.c = {name}v.c + 1),
{name}q AS (SELECT pose, count(*) AS n, quantile_cont(d, 0.5) AS m, quantile_cont(d, 0.75) AS q FROM {name}d GROUP BY 1),
{name}c AS (SELECT pose, CASE WHEN n >= greatest({least}, CAST(floor({share} * (SELECT count(*) FROM {points})) AS BIGINT)) THEN m + 0.35 * q + {outside * PENALTY} * (1 - n / (SELECT count(*) FROM {points})) ELSE {unfit} END AS cost FROM po LEFT JOIN {name}q USING (pose))"""


@query(f"""WITH po AS (SELECT CAST(i AS INT) AS pose, tx, ty, yaw FROM (SELECT unnest(range({len(POSES)})) AS i, unnest({[p[0] for p in POSES]}::DOUBLE[]) AS tx, unnest({[p[1] for p in POSES]}::DOUBLE[]) AS ty, unnest({[p[2] for p in POSES]}::DOUBLE[]) AS yaw)),
hh AS (SELECT count(*) // 10 AS h FROM part), fa AS (SELECT (p_partkey - 1) // 10 AS r, (p_partkey - 1) % 10 AS c, p_size / 50.0::DOUBLE AS d FROM part), fb AS (SELECT (p_partkey - 1) // 10 AS r, (p_partkey - 1) % 10 AS c, (p_size * 7 % 50) / 50.0::DOUBLE AS d FROM part),
wp AS (SELECT l_quantity / 6.0::DOUBLE AS x, (l_orderkey * 31 + l_linenumber * 7) % 1000 / 1000.0::DOUBLE * 18 AS y FROM lineitem), ob AS (SELECT s_suppkey * 37 % 90 / 10.0::DOUBLE AS x, s_suppkey * 53 % 180 / 10.0::DOUBLE AS y FROM supplier),
{_cost_sql('w', 'wp', 'fa', 0.6, 500, 0.15, poses.NO_FIT + PENALTY)}, {_cost_sql('o', 'ob', 'fb', 0.8, 1, 0.0, 1.5 * PENALTY)}
SELECT pose, round(CASE WHEN wc.cost = {poses.NO_FIT + PENALTY} THEN wc.cost ELSE wc.cost + {WEIGHT} * oc.cost END, 6) AS cost FROM wc JOIN oc USING (pose)""")
def pose_score(spark, sf):
    """The cost of each pose of a list: quantiles of the field at the placed points, what is off the map, known objects."""
    walls, known = guides(spark, sf)
    costs = poses.pose_costs(walls, POSES, known, WEIGHT)
    return spark.createDataFrame([(k, round(c, 6)) for k, c in enumerate(costs)], "pose int, cost double")


@query()
def pose_search(spark, sf):
    """The cheapest pose of a few generations of the search: a job each, whose rows at the driver are one a pose.

    As for a real cloud, the band is thinned first: a point for each square of a tenth of a metre, the mean of its points.
    """
    walls, known = guides(spark, sf, thinned=True)
    pose, cost = poses.search(lambda some: poses.pose_costs(walls, some, known, WEIGHT), [(-4.0, 4.0), (-4.0, 4.0), (-3.2, 3.2)], generations=3, size=4, seed=5, halvings=0)
    return spark.createDataFrame([(*pose, cost)], "tx double, ty double, yaw double, cost double")
