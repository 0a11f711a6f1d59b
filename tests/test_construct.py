import math
import random

import pytest

from orbisframe.functions.curves import control_points, flatten
from orbisframe.operators import construct
from orbisframe.sources import codec

# One text of each stored kind of field.
STORED = (
    "North", "Southwest", "36", "(42,East)", "West", "[36,(42,East),West]", "[]", "(72,45.6)", "[(72,45.6),((49,Southeast),0.1)]",
    "LakeIsland", "Confluence", "Mouth", "Fresh", "Hunting", "Glacier(-4)", "Matrix([(23,24),(12,20),(13,4)])",
)


@pytest.mark.parametrize("text", STORED)
def test_codec(text):
    assert codec.dump(codec.parse(text)) == text
    assert codec.parse(text.replace(",", " ,  ")) == codec.parse(text)


def test_curve_pieces():
    """Control points lie a third of a piece's length from its ends, along the
    line between the neighbours of that end, or along the piece at an outer one."""
    rng = random.Random(4)
    line = [(k + rng.random(), rng.uniform(-3, 3)) for k in range(12)]
    pieces = control_points(line)
    assert len(pieces) == 11
    for k, (p, c0, c1, q) in enumerate(pieces):
        assert (p, q) == (line[k], line[k + 1])
        third = math.dist(p, q) / 3
        before, after = line[k - 1] if k else p, line[k + 2] if k < 10 else q
        for at, c, along in ((p, c0, (q[0] - before[0], q[1] - before[1])), (q, c1, (p[0] - after[0], p[1] - after[1]))):
            step = (c[0] - at[0], c[1] - at[1])
            assert math.hypot(*step) == pytest.approx(third)
            assert step[0] * along[1] - step[1] * along[0] == pytest.approx(0, abs=1e-9) and step[0] * along[0] + step[1] * along[1] > 0
    drawn = flatten(line)
    assert drawn[0] == line[0] and drawn[-1] == line[-1] and set(line) <= set(drawn) and flatten(line[:2]) == line[:2]


def test_tiles_cover_the_map(spark):
    points = construct.gen_points(spark, 200)
    tiles = construct.voronoi(points, construct.delaunay(points)).collect()
    assert len(tiles) == points.where("key >= 0").count() and abs(sum(t.area for t in tiles) - 64800) < 1e-3


@pytest.mark.parametrize("halo", [4, 0.2])
def test_blocks_give_the_triangles_of_all_points(spark, halo, monkeypatch):
    monkeypatch.setattr(construct, "HALO", halo)
    monkeypatch.setattr(construct, "BLOCK", 6)
    rng = random.Random(6)
    rows = [(k, rng.uniform(-180, 180), rng.gauss(0, 20)) for k in range(500)] + [(600 + k, rng.gauss(50, 1), rng.gauss(30, 1)) for k in range(200)]
    rows += [(-1, -540.0, -270.0), (-2, 540.0, -270.0), (-3, -540.0, 270.0), (-4, 540.0, 270.0)]
    got = construct.delaunay(spark.createDataFrame(rows, "key long, x double, y double")).collect()
    rows.sort()
    want = [tuple(rows[k][0] for k in t) for t in construct.triangulate([r[1:] for r in rows])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_few_points(spark):
    far = [(-1, -540.0, -270.0), (-2, 540.0, -270.0), (-3, -540.0, 270.0), (-4, 540.0, 270.0)]
    one = spark.createDataFrame([(0, 1.0, 2.0), *far], "key long, x double, y double")
    assert construct.delaunay(one).count() == 4 and construct.delaunay(one.where("key < 0")).count() == 0


def test_sphere_of_tiles(spark):
    points = construct.gen_points(spark, 300, sphere=True)
    cells = construct.voronoi(points, construct.delaunay(points), sphere=True).collect()
    n = points.where("key >= 0").count()
    assert abs(n - 300) < 25 and len(cells) == n
    whole = 4 * math.pi * 6378137.0**2 / 12392029000.0
    assert abs(sum(c.area for c in cells) - whole) < 1e-6 * whole
    sizes = sorted(c.area for c in cells)
    assert sizes[len(sizes) // 10] > 0.3 * whole / n and sizes[-len(sizes) // 10] < 2.5 * whole / n  # as large at the poles as at the equator
