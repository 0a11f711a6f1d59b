"""Overlays against clipping of convex polygons and against sampled points."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from orbisframe.operators import overlay
from orbisframe.operators.construct import clip_ring
from orbisframe.operators.outlines import signed_area
from orbisframe.operators.terrain import Limits
from orbisframe.plans.registry import rings
from orbisframe.plans.world import World

SF = "/root/testdata/sf0.001"

SCHEMA = "key string, rings array<array<struct<x:double,y:double>>>"


def _layer(spark, shapes):
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings] if rings is not None else None) for k, rings in shapes], SCHEMA)


def _winding(rings, p):
    total = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
            if (ay <= p[1]) != (by <= p[1]) and ax + (p[1] - ay) / (by - ay) * (bx - ax) > p[0]:
                total += 1 if by > ay else -1
    return total


def _shapes(rng, n, points):
    """Polygons that cross themselves, far from simple ones."""
    out = []
    for k in range(n):
        x, y = rng.uniform(-30, 30), rng.uniform(-20, 20)
        out.append((f"k{k}", [[(x + rng.gauss(0, 12), y + rng.gauss(0, 12)) for _ in range(points)] for _ in range(rng.randint(1, 2))]))
    return out


def _rows(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["a"], r["b"] if "b" in df.columns else None), []).append([(p["x"], p["y"]) for p in r["ring"]])
    return out


@pytest.mark.parametrize("per_cell", [24, 2])
def test_results_wind_once_around_their_points(spark, per_cell, monkeypatch):
    monkeypatch.setattr(overlay, "PER_CELL", per_cell)
    rng = random.Random(4)
    a, b = _shapes(rng, 4, 7), _shapes(rng, 4, 6)
    la, lb = _layer(spark, a), _layer(spark, b)
    both, left, valid = _rows(overlay.intersection(la, lb)), _rows(overlay.difference(la, lb)), _rows(overlay.make_valid(la))
    for _ in range(1500):
        p = (rng.uniform(-60, 60), rng.uniform(-50, 50))
        ins = [{k for k, r in x if _winding(r, p)} for x in (a, b)]
        for k, _ in a:
            assert _winding(valid.get((k, None), []), p) == (k in ins[0])
            assert _winding(left.get((k, None), []), p) == (k in ins[0] and not ins[1])
            for m, _ in b:
                assert _winding(both.get((k, m), []), p) == (k in ins[0] and m in ins[1])


def test_convex_clip(spark):
    rng = random.Random(9)
    lim = Limits(west=-10.0, south=-8.0, width=21.0, height=15.0)
    shapes = []
    for k in range(30):
        x, y, r = rng.uniform(-15, 15), rng.uniform(-12, 12), rng.uniform(1, 9)
        turns = sorted(rng.uniform(0, math.tau) for _ in range(8))
        shapes.append((f"k{k}", [[(x + r * math.cos(t), y + r * math.sin(t)) for t in turns]]))
    got = {r["a"]: r["s"] for r in overlay.clip(_layer(spark, shapes), lim).groupBy("a").agg(F.sum("area").alias("s")).collect()}
    for k, (ring,) in shapes:
        want = clip_ring(ring, lim)
        want = abs(signed_area(want)) if len(want) > 2 else 0.0
        assert abs(got.get(k, 0.0) - want) < 1e-6


def test_shared_sides_holes_and_odd_rows(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    a = _layer(spark, [("one", [square(0, 0, 4)]), ("one", [square(0, 0, 4)]), (None, [square(0, 0, 9)]), ("none", None), ("line", [[(0, 0), (1, 1)]]), ("back", [square(10, 0, 2)[::-1]])])
    b = _layer(spark, [("hole", [square(1, 1, 2)]), ("beside", [square(4, 0, 4)]), ("half", [square(10, 0, 1)])])
    got = {k: sorted(abs(signed_area(r)) * math.copysign(1, signed_area(r)) for r in v) for k, v in _rows(overlay.difference(a, b)).items()}
    assert {k[0]: [round(x, 6) for x in v] for k, v in got.items()} == {"one": [-4, 16], "back": [3]}
    both = {k: round(sum(map(signed_area, v)), 6) for k, v in _rows(overlay.intersection(a, b)).items()}
    assert both == {("one", "hole"): 4, ("back", "half"): 1}
    ring = [r for v in _rows(overlay.make_valid(a.where("key = 'one'"))).values() for r in v]
    assert len(ring) == 1 and sorted(ring[0]) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    whole = overlay.regions(overlay.difference(a, b)).where("key = 'one'").first()
    assert len(whole["rings"]) == 2 and round(whole["area"], 6) == 12
    empty = a.limit(0)
    assert overlay.intersection(empty, b).count() == 0 and overlay.intersection(a, b.limit(0)).count() == 0
    assert overlay.make_valid(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_curved_outlines_lie_in_the_map(spark):
    w = World(spark, SF)
    t, lim = rings(w), Limits()
    coast = overlay.coast(t, F.col("grouping_") == "Ocean", "grouping_", lim, 100.0).collect()
    assert abs(sum(r["area"] for r in coast) - 64800) < 1e-3
    assert {r["kind"] for r in coast} == {"land", "ocean"}
    for r in coast:
        assert all(-180 - 1e-6 <= p["x"] <= 180 + 1e-6 and -90 - 1e-6 <= p["y"] <= 90 + 1e-6 for p in r["ring"])
    got = overlay.region_outlines(t, "nation_id", lim, 100.0).collect()
    assert sorted(r["theme"] for r in got) == sorted({str(r[0]) for r in w.tiles.where("nation_id is not null").select("nation_id").collect()})
    for r in got:
        assert r["area"] > 0 and r["rings"][0] and abs(sum(signed_area([(p["x"], p["y"]) for p in ring]) for ring in r["rings"]) - r["area"]) < 1e-6


def test_cells_and_blocks_go_to_calls_together(spark, monkeypatch):
    """A call takes a square of cells or all regions of a block, and work is dealt by its sides, not by its bytes."""
    square = lambda k, x: (f"k{k}", [[{"x": x + a, "y": 0.1 + b} for a, b in ((0.0, 0.0), (7.3, 0.0), (7.3, 9.1), (0.0, 9.1))]])
    layer = spark.createDataFrame([square(k, 5.0 * k) for k in range(40)], "key string, rings array<array<struct<x:double,y:double>>>")
    want = sorted((r.a, round(r.area, 6)) for r in overlay.make_valid(layer).collect())
    assert [x for _, x in want] == [round(7.3 * 9.1, 6)] * 40
    monkeypatch.setattr(overlay, "PER_TASK", 10)
    monkeypatch.setattr(overlay, "PER_CELL", 1)
    dealt = []
    keep = overlay._lines
    monkeypatch.setattr(overlay, "_lines", lambda pieces, corners, operation, cell, tasks: dealt.append(tasks) or keep(pieces, corners, operation, cell, tasks))
    assert sorted((r.a, round(r.area, 6)) for r in overlay.make_valid(layer).collect()) == want and dealt == [17]
