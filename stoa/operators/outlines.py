"""Outlines of rasters' regions, traced by list ranking, and outlines moved onto the wall lines beside them.

A region's border is its cells' free sides. Which side follows which is told by a cell's eight neighbours alone; the order
within a loop comes by pointer jumping, a number of rounds that grows with the logarithm of the longest loop. Regions that fit a task
are ranked there, many at once; for larger ones each round is a job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoa.operators.rooms import simplified_column
from stoa.session import written

# Sides of a cell in the order of a walk with the region on the right: above, right, below, left. Of each the way along it and the way out.
ALONG = ((0, 1), (1, 0), (0, -1), (-1, 0))
OUT = ((-1, 0), (0, 1), (1, 0), (0, -1))
TILE = 32


def border_sides(cells: DataFrame, key: str, width: int) -> DataFrame:
    """``(key, side, next, turns)``: each free side of the cells (``key, row, col``, distinct) and the one that follows it.

    A side is ``(row * width + col) * 4`` plus its place among the four sides. Cells that touch at a corner belong together.
    """
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    bit = {s: 1 << k for k, s in enumerate(around)}
    # a cell tells each neighbour where, seen from there, it lies
    told = F.explode(F.array(*[F.struct((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.lit(bit[i, j]).alias("b")) for i, j in around]))
    near = cells.select(key, told.alias("t")).select(key, "t.*").groupBy(key, "row", "col").agg(F.bit_or("b").alias("b")).where(F.col("b").bitwiseAND(bit[0, 0]) > 0)
    has = lambda s: F.col("b").bitwiseAND(bit[s]) > 0
    name = lambda s, k: (((F.col("row") + s[0]) * width + F.col("col") + s[1]) * 4 + k).cast("long")
    sides = []
    for k, (along, out) in enumerate(zip(ALONG, OUT, strict=True)):
        corner = (along[0] + out[0], along[1] + out[1])
        follows = F.when(has(corner), name(corner, (k + 3) % 4)).when(has(along), name(along, k)).otherwise(name((0, 0), (k + 1) % 4))
        sides.append(F.when(~has(out), F.struct(name((0, 0), k).alias("side"), follows.alias("next"), (has(corner) | ~has(along)).alias("turns"))))
    return near.select(key, F.explode(F.array_compact(F.array(*sides))).alias("s")).select(key, "s.*")


def ranked_loops(links: DataFrame, key: str) -> DataFrame:
    """``(key, side, loop, left)``: the least side of each one's loop, and how many steps it lies ahead.

    Pointer jumping: each side knows the least side of a stretch ahead and how far off it is; stretches double in length until
    none of them learns of a lesser one, which is when every stretch goes round its loop.
    """
    at = written(links.select(key, "side", F.col("next").alias("ahead"), F.col("side").alias("loop"), F.lit(0).cast("long").alias("left")), "loops")
    length = 1
    while True:
        far = at.select(key, F.col("side").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("loop").alias("_loop"), F.col("left").alias("_left"))
        lesser = F.col("_loop") < F.col("loop")
        new = at.join(far, [key, "ahead"]).select(key, "side", F.col("_ahead").alias("ahead"), F.when(lesser, F.col("_loop")).otherwise(F.col("loop")).alias("loop"), F.when(lesser, F.col("_left") + length).otherwise(F.col("left")).alias("left"), lesser.alias("learnt"))
        new = written(new, "loops")
        if new.where("learnt").isEmpty():
            return new.select(key, "side", "loop", "left")
        at, length = new.drop("learnt"), length * 2


def _jobs_outlines(own: DataFrame, key: str, width: int) -> DataFrame:
    """``outlines`` of distinct cells without nulls, a job a round."""
    sides = written(border_sides(own, key, width), "sides")
    placed = written(ranked_loops(sides, key), "ranks")
    turning = sides.where("turns")
    ends = turning.select(key, "side").unionByName(turning.select(key, F.col("next").alias("side"))).distinct()  # of each straight run both ends
    cell = F.shiftrightunsigned("side", 2)
    corners = placed.join(ends, [key, "side"]).select(key, "loop", "left", (cell % width).alias("c"), F.floor(cell / width).alias("r"))
    # the start lies 0 steps ahead of itself, the others by falling distance
    order = F.array_sort(F.collect_list(F.struct(F.when(F.col("left") == 0, F.lit(-(1 << 62))).otherwise(-F.col("left")).alias("at"), "c", "r")))
    rings = corners.groupBy(key, "loop").agg(order.alias("_ring"))
    n = F.size("_ring")
    same = lambda a, b: (a["c"] == b["c"]) & (a["r"] == b["r"])
    rings = rings.select(key, "loop", F.filter("_ring", lambda p, i: (i == 0) | ~same(p, F.get("_ring", i - 1))).alias("_ring"))
    rings = rings.select(key, "loop", F.filter("_ring", lambda p, i: (n == 1) | (i < n - 1) | ~same(p, F.get("_ring", F.lit(0)))).alias("_ring"))
    after = lambda i: F.get("_ring", (i + 1) % n)
    twice = F.aggregate(F.transform("_ring", lambda p, i: p["c"] * after(i)["r"] - after(i)["c"] * p["r"]), F.lit(0).cast("long"), lambda s, x: s + x)
    rings = rings.withColumn("_twice", twice)
    best = F.min_by(F.struct("_ring", "_twice"), F.struct((-F.col("_twice")).alias("a"), "loop"))
    found = rings.groupBy(key).agg(best.alias("b"))
    return found.select(key, F.transform("b._ring", lambda p: F.array(p["c"].cast("double"), p["r"].cast("double"))).alias("outline"), (F.col("b._twice") / 2.0).alias("area"))


def _traced(keys: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, size, twice the area, c, r)``: of each key (whole numbers, rising) the outline's corners, one after the other, and how many they are."""
    order = np.lexsort((col, row, keys))
    keys, row, col = keys[order], row[order], col[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])]
    keys, row, col = keys[new], row[new], col[new]
    spots = [np.unique(np.concatenate([v - 1, v, v + 1])) for v in (row, col)]  # few numbers, neighbours still beside each other
    wide = len(spots[1])
    at = (keys * len(spots[0]) + np.searchsorted(spots[0], row)) * wide + np.searchsorted(spots[1], col)

    def beside(step: tuple[int, int]) -> np.ndarray:
        want = at + step[0] * wide + step[1]
        found = np.minimum(np.searchsorted(at, want), len(at) - 1)
        return np.where(at[found] == want, found, -1)

    near = {(i, j): beside((i, j)) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j}
    here = np.arange(len(at))
    free, follows, turns = (np.empty((len(at), 4), kind) for kind in (bool, np.int64, bool))
    for k, (along, out) in enumerate(zip(ALONG, OUT, strict=True)):
        corner, ahead = near[along[0] + out[0], along[1] + out[1]], near[along]
        free[:, k] = near[out] < 0
        follows[:, k] = np.where(corner >= 0, corner * 4 + (k + 3) % 4, np.where(ahead >= 0, ahead * 4 + k, here * 4 + (k + 1) % 4))
        turns[:, k] = (corner >= 0) | (ahead < 0)
    side = np.flatnonzero(free.ravel())
    place = np.cumsum(free.ravel()) - 1
    after, turn, cell = place[follows.ravel()[side]], turns.ravel()[side], side // 4
    loop, left, far, length = np.arange(len(side)), np.zeros(len(side), np.int64), after, 1
    while (lesser := loop[far] < loop).any():  # as ranked_loops
        loop, left = np.where(lesser, loop[far], loop), np.where(lesser, left[far] + length, left)
        far, length = far[far], length * 2
    ends = turn.copy()
    ends[after[turn]] = True
    ends = np.flatnonzero(ends)
    ends = ends[np.lexsort((np.where(left[ends] == 0, -(1 << 62), -left[ends]), loop[ends]))]

    def firsts(v: np.ndarray) -> np.ndarray:
        return np.r_[True, v[1:] != v[:-1]]

    c, r, ring = col[cell[ends]], row[cell[ends]], loop[ends]
    keep = firsts(ring) | firsts(c) | firsts(r)
    c, r, ring = c[keep], r[keep], ring[keep]
    begin = np.flatnonzero(firsts(ring))
    last = np.r_[begin[1:], len(ring)] - 1
    keep = np.ones(len(ring), bool)
    keep[last[(last > begin) & (c[last] == c[begin]) & (r[last] == r[begin])]] = False
    c, r, ring = c[keep], r[keep], ring[keep]
    begin = np.flatnonzero(firsts(ring))
    size = np.diff(np.r_[begin, len(ring)])
    then = np.arange(len(ring)) + 1
    then[begin + size - 1] = begin
    twice = np.add.reduceat(c * r[then] - c[then] * r, begin)
    owner = keys[cell[ring[begin]]]
    best = np.lexsort((ring[begin], -twice, owner))
    best = best[firsts(owner[best])]
    chosen = np.repeat(begin[best], size[best]) + np.arange(size[best].sum()) - np.repeat(np.cumsum(size[best]) - size[best], size[best])
    return owner[best], size[best], twice[best], c[chosen], r[chosen]


def _task_outlines(own: DataFrame, key: str, rows: int = 1 << 18) -> DataFrame:
    """``outlines`` of cells without nulls, repeats included, whose keys fit a task: about ``rows`` rows of whole keys are traced at once."""
    kind = own.schema[key].dataType.simpleString()

    def traced(table: pa.Table, codes: np.ndarray) -> pa.RecordBatch:
        owner, size, twice, c, r = _traced(codes, table["row"].to_numpy(), table["col"].to_numpy())
        points = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * 2), pa.array(np.stack([c, r], 1).astype(float).ravel()))
        rings = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), points)
        names = table[key].take(pa.array(np.searchsorted(codes, owner))).combine_chunks()
        return pa.RecordBatch.from_arrays([names.chunk(0) if isinstance(names, pa.ChunkedArray) else names, rings, pa.array(twice / 2.0)], names=[key, "outline", "area"])

    def coded(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        name = table[key].combine_chunks()
        return table, (name.chunk(0) if isinstance(name, pa.ChunkedArray) else name).dictionary_encode().indices.to_numpy().astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= rows:
                table, codes = coded(held)
                whole = int(np.searchsorted(codes, codes[-1]))  # the last key may go on
                if whole:
                    yield traced(table.slice(0, whole), codes[:whole])
                held = table.slice(whole).to_batches()
                n = len(table) - whole
        if n:
            yield traced(*coded(held))

    dealt = own.repartition(key).sortWithinPartitions(key)
    return dealt.select(key, "row", "col").mapInArrow(run, f"`{key}` {kind}, outline array<array<double>>, area double")


def outlines(cells: DataFrame, key: str, width: int, most: int = 200_000) -> DataFrame:
    """``(key, outline, area)``: of each key's cells (``key, row, col``, columns below ``width``) the loop around the largest area.

    The outline is an array of ``[col, row]`` through cell centres, from the loop's first side on, with a corner at every turn
    of the border; the area is that within the centres, so regions one cell thick have 0. Equal areas: the loop of the least
    side. Loops around holes enclose no area of the region and don't count. Rows with nulls take no part; repeats count once.
    A key's corners are one array: its border's turns, not its cells. Keys of up to ``most`` rows are traced within a task.
    """
    own = cells.where(F.col(key).isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()).select(key, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    large = written(own.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key), "large-keys")
    if large.isEmpty():
        return _task_outlines(own, key)
    return _task_outlines(own.join(large, key, "left_anti"), key).unionByName(_jobs_outlines(own.join(large, key, "left_semi").distinct(), key, width))


def polygons(cells: DataFrame, key: str, width: int, origin: tuple[float, float], size: float, epsilon: float) -> DataFrame:
    """``(key, polygon)``: outlines with few corners, in metres: deviations up to ``epsilon`` (a cell at least) go.

    Regions without area, of which fewer than three corners stay, are the box around their cells.
    """
    traced = outlines(cells, key, width).select(key, simplified_column(F.col("outline"), max(1.0, epsilon / size)).alias("_p"))
    box = cells.groupBy(key).agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    corner = lambda c, r: F.array(F.col(c).cast("double") + int(c == "c1"), F.col(r).cast("double") + int(r == "r1"))
    whole = F.array(corner("c0", "r0"), corner("c1", "r0"), corner("c1", "r1"), corner("c0", "r1"))
    chosen = traced.join(box, key).select(key, F.when(F.size("_p") >= 3, F.col("_p")).otherwise(whole).alias("_p"))
    return chosen.select(key, F.transform("_p", lambda p: F.array(origin[0] + p[0] * size, origin[1] + p[1] * size)).alias("polygon"))


def area(polygon: np.ndarray) -> float:
    """The area within a closed polygon of points in rows."""
    x, y = polygon.T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def snapped(polygon: np.ndarray, walls: np.ndarray, origin: tuple[float, float], size: float, reach: int, support: int, shape: tuple[int, int]) -> np.ndarray:
    """A polygon (points in rows) whose sides along an axis lie on the best wall line beside them.

    ``walls``: rows and columns of wall cells, in rows. Sides are taken in turn, each as those before left it: one that leans less than
    0.35 moves to the line within ``reach`` cells that has the most wall along it, the first of equals, if that is ``support`` cells at least.
    Corners that fall together are one. If under three stay, or half a square metre or less within, the polygon stays as it was.
    """
    if len(polygon) < 3 or reach <= 0:
        return polygon
    moved, n = polygon.copy(), len(polygon)
    for i in range(n):
        j = (i + 1) % n
        off = np.abs(moved[j] - moved[i])
        if off[1] > 0 and off[0] / off[1] < 0.35:
            axis = 0
        elif off[0] > 0 and off[1] / off[0] < 0.35:
            axis = 1
        else:
            continue
        other, middle = 1 - axis, float(moved[i, axis] + moved[j, axis]) * 0.5
        ends = sorted((moved[i, other], moved[j, other]))
        limit = (shape[1] - 1, shape[0] - 1)
        low = int(np.clip(np.floor((ends[0] - origin[other]) / size), 0, limit[other]))
        high = int(np.clip(np.ceil((ends[1] - origin[other]) / size), 0, limit[other]))
        at = round((middle - origin[axis]) / size)
        first, last = max(0, at - reach), min(limit[axis], at + reach)
        line, place = walls[:, 1 - axis], walls[:, axis]  # a cell's place on the axis that moves, and along the other
        on = line[(line >= first) & (line <= last) & (place >= low) & (place <= high)]
        if last < first or not len(on):
            continue
        counts = np.bincount(on - first)
        if counts.max() >= support:
            moved[[i, j], axis] = origin[axis] + (first + int(counts.argmax())) * size
    kept = [moved[0]]
    for p in moved[1:]:
        if np.hypot(*(p - kept[-1])) > 1e-6:
            kept.append(p)
    if len(kept) > 2 and np.hypot(*(kept[0] - kept[-1])) <= 1e-6:
        kept.pop()
    kept = np.asarray(kept)
    return polygon if len(kept) < 3 or area(kept) <= 0.5 else kept


def snapped_to_walls(rooms: DataFrame, key: str, polygon: str, walls: DataFrame, origin: tuple[float, float], size: float, shape: tuple[int, int], distance: float, support: float) -> DataFrame:
    """``(key, polygon)`` of every room, its sides moved onto wall lines within ``distance`` metres that have ``support`` metres of wall.

    ``walls``: distinct ``row, col`` from 0 on. A room meets the wall cells of the tiles around its sides, however many lie within it;
    it gets its corners and those cells. Rooms with null or fewer than three corners come as they are.
    """
    reach, least = max(0, round(distance / size)), max(2, round(support / size))
    margin = 3 * reach + 3  # a corner moves with both its sides, and a side looks as far again
    tile = lambda v, k, by: F.floor((F.floor((v - origin[k]) / size) + by) / TILE)
    ring = F.col(polygon)
    sides = F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))
    side = rooms.where(F.size(ring) >= 3).select(key, F.explode(sides).alias("s"))
    span = lambda k: F.sequence(tile(F.least(F.col("s.a")[k], F.col("s.b")[k]), k, -margin), tile(F.greatest(F.col("s.a")[k], F.col("s.b")[k]), k, margin))
    tiles = side.select(key, F.explode(span(0)).alias("tc"), span(1).alias("_rows")).select(key, "tc", F.explode("_rows").alias("tr")).distinct()
    laid = walls.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).withColumns({"tc": F.floor(F.col("col") / TILE), "tr": F.floor(F.col("row") / TILE)})
    met = laid.join(tiles, ["tc", "tr"]).groupBy(F.col(key).alias("_room")).agg(F.collect_list(F.shiftleft("row", 31) + F.col("col")).alias("_near"))

    @F.pandas_udf("array<array<double>>")
    def moved(rings: pd.Series, near: pd.Series) -> pd.Series:
        out = []
        for p, packed in zip(rings, near, strict=True):
            if p is not None and len(p) >= 3:
                at = np.asarray([] if packed is None else packed, np.int64)
                p = snapped(np.array([list(q) for q in p], float), np.stack([at >> 31, at & ((1 << 31) - 1)], 1), origin, size, reach, least, shape).tolist()
            out.append(p)
        return pd.Series(out, dtype=object)

    laid_rooms = rooms.select(key, ring.alias("_p"))
    return laid_rooms.join(met, F.col(key) == F.col("_room"), "left").select(key, moved("_p", "_near").alias("polygon"))
