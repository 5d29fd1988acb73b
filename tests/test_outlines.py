"""Outlines by list ranking against a walk in plain Python, and sides moved to walls."""

import numpy as np
import pytest

from stoa.operators import outlines


def walked(cells: set) -> list:
    """Border loops of a set of cells by walking cell by cell: ``[(twice the area, first side, corners)]``."""
    ways, outs = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(-1, 0), (0, 1), (1, 0), (0, -1)]
    free = {(r, c, k) for r, c in cells for k in range(4) if (r + outs[k][0], c + outs[k][1]) not in cells}
    loops = []
    for start in sorted(free):
        if start not in free:
            continue
        r, c, k = start
        path = []
        while (r, c, k) in free:
            free.discard((r, c, k))
            path.append((c, r))
            (i, j), (a, b) = ways[k], outs[k]
            if (r + i + a, c + j + b) in cells:
                r, c, k = r + i + a, c + j + b, (k + 3) % 4
            elif (r + i, c + j) in cells:
                r, c = r + i, c + j
            else:
                k = (k + 1) % 4
        twice = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(path, path[1:] + path[:1], strict=True))
        loops.append((-twice, start, path))
    return sorted(loops)


def thinned(path: list) -> list:
    """A closed path of cells without repeats and without cells amid a straight run."""
    p = [q for i, q in enumerate(path) if i == 0 or q != path[i - 1]]
    p = p[:-1] if len(p) > 1 and p[0] == p[-1] else p
    way = lambda a, b: (np.sign(b[0] - a[0]), np.sign(b[1] - a[1]))
    return [q for i, q in enumerate(p) if len(p) < 3 or way(p[i - 1], q) != way(q, p[(i + 1) % len(p)])]


def test_outlines_equal_a_walk(spark):
    """Blobs with holes, diagonal touches, single cells, thin lines and several regions a key; long spirals need many rounds."""
    rng = np.random.default_rng(5)
    shapes = {k: {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((14, 17)) < share), strict=True)} for k, share in enumerate((0.05, 0.4, 0.6, 0.8, 0.95))}
    shapes[10], shapes[11] = {(3, 3)}, {(2, c) for c in range(1, 9)}
    spiral, r, c, i, j, n = {(20, 20)}, 20, 20, 0, 1, 2
    for _ in range(12):
        for _ in range(n):
            r, c = r + i, c + j
            spiral.add((r, c))
        i, j, n = j, -i, n + 2 if j == 0 else n
    shapes[12] = {(r + 60, c + 60) for r, c in spiral}
    rows = [(k, r, c) for k, s in shapes.items() for r, c in s]
    df = spark.createDataFrame([*rows, rows[0], (None, 1, 1), (7, None, 1)], "room long, row long, col long")
    got = {x["room"]: x for x in outlines.outlines(df, "room", 200).collect()}
    assert got.keys() == shapes.keys()
    for k, s in shapes.items():
        lost, _, path = walked(s)[0]
        assert got[k]["area"] == -lost / 2, k
        assert thinned([tuple(int(v) for v in p) for p in got[k]["outline"]]) == thinned(path), k
    assert outlines.outlines(df.limit(0), "room", 200).collect() == []


def test_polygons_of_boxes_and_lines(spark):
    df = spark.createDataFrame([(1, r, c) for r in range(2, 9) for c in range(3, 7)] + [(2, 5, c) for c in range(4)], "room long, row long, col long")
    got = {r["room"]: r["polygon"] for r in outlines.polygons(df, "room", 50, (10.0, 20.0), 0.5, 0.2).collect()}
    assert got[1] == [[11.5, 21.0], [13.0, 21.0], [13.0, 24.0], [11.5, 24.0]]
    assert got[2] == [[10.0, 22.5], [12.0, 22.5], [12.0, 23.0], [10.0, 23.0]]  # no area: the box of its cells


def test_sides_move_to_walls(spark):
    """Walls two cells beside the sides; a room far from walls, one of two corners and one without any stay."""
    square = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w]]
    walls = [(r, 8) for r in range(8, 32)] + [(r, 31) for r in range(8, 32)] + [(9, c) for c in range(8, 32)] + [(r, 9) for r in range(12, 20)]
    rooms = spark.createDataFrame([(1, square(1.0, 1.0, 2.0)), (2, square(90.0, 90.0, 3.0)), (3, [[0.0, 0.0], [1.0, 1.0]]), (4, None)], "room long, polygon array<array<double>>")
    df = spark.createDataFrame(walls, "row long, col long")
    got = {r["room"]: r["polygon"] for r in outlines.snapped_to_walls(rooms, "room", "polygon", df, (0.0, 0.0), 0.1, (1000, 1000), 0.25, 0.5).collect()}
    assert np.allclose(got[1], [[0.8, 0.9], [3.1, 0.9], [3.1, 3.0], [0.8, 3.0]])
    assert got[2] == square(90.0, 90.0, 3.0) and got[3] == [[0.0, 0.0], [1.0, 1.0]] and got[4] is None
    none = outlines.snapped_to_walls(rooms, "room", "polygon", df.limit(0), (0.0, 0.0), 0.1, (1000, 1000), 0.25, 0.5).collect()
    assert {r["room"]: r["polygon"] for r in none}[1] == square(1.0, 1.0, 2.0)


@pytest.mark.parametrize("wide,moves", [(1.0, True), (0.6, False)])
def test_outlines_of_half_a_metre_stay(wide, moves):
    """A polygon whose snapped area is too small comes back unchanged."""
    p = np.array([[0.0, 0.0], [wide, 0.0], [wide, 1.0], [0.0, 1.0]])
    walls = np.array([(r, 1) for r in range(11)])
    got = outlines.snapped(p, walls, (0.0, 0.0), 0.1, 2, 2, (100, 100))
    assert np.array_equal(got, p) != moves


def test_outlines_within_tasks_and_by_jobs(spark, monkeypatch):
    """Some keys fit a task, some don't; batches end amid keys, and no round is a job where all fit."""
    rng = np.random.default_rng(8)
    shapes = {f"r{k}": {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((9, 11)) < 0.1 + k % 8 / 10), strict=True)} for k in range(40)}
    rows = [(k, r, c) for k, s in shapes.items() for r, c in s]
    df = spark.createDataFrame(rows + rows[::3], "room string, row long, col long")
    own = outlines._task_outlines
    monkeypatch.setattr(outlines, "_task_outlines", lambda cells, key: own(cells, key, 7))
    for most in (0, 60, 1000):
        if most == 1000:
            monkeypatch.setattr(outlines, "ranked_loops", None)
        got = {x["room"]: x for x in outlines.outlines(df, "room", 20, most).collect()}
        assert got.keys() == {k for k, s in shapes.items() if s}
        for k, x in got.items():
            lost, _, path = walked(shapes[k])[0]
            assert x["area"] == -lost / 2 and thinned([tuple(map(int, q)) for q in x["outline"]]) == thinned(path), k
