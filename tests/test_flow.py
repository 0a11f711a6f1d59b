"""Flow and other order-dependent work against the plain loops."""

import random

import pytest

from orbisframe.operators import water


def flow_by_loop(tiles, edges):
    """Tiles one by one from the highest; ``tiles``: fid, height, rain, sea."""
    height = {f: h for f, h, _, _ in tiles} | {None: float("-inf")}
    near = {f: sorted({d for s, d in edges if s == f and d in height}, key=lambda d: (d is not None, d or 0)) for f in height if f is not None}
    scale = (len(tiles) / 10000) ** 0.25
    flow, kept, to = dict.fromkeys(near, 0.0), dict.fromkeys(near, 0.0), {}
    for f, h, rain, sea in sorted(tiles, key=lambda t: (-t[1], t[0])):
        if sea:
            continue
        flow[f] += rain / scale
        low = min((height[n] for n in near[f]), default=float("inf"))
        if low > h:
            kept[f] = flow[f]
            continue
        to[f] = [n for n in near[f] if height[n] == low]
        for n in to[f]:
            if n is not None:
                flow[n] += flow[f] / len(to[f])
    return {f: (round(flow[f], 6), round(kept[f], 6), sorted(-1 if n is None else n for n in to.get(f, []))) for f in near}


@pytest.mark.parametrize("steps", [3, 40])
def test_flow_equals_the_loop(spark, steps):
    """Grids with level ground, sinks, sea and an open side."""
    rng = random.Random(steps)
    side = 14
    tiles = [(k, float(rng.randrange(steps) - 1), rng.random() * 5, rng.random() < 0.1) for k in range(side * side)]
    edges = [(a, b) for a in range(side * side) for b in (a - 1, a + 1, a - side, a + side) if 0 <= b < side * side and abs(a % side - b % side) < 2]
    edges += [(a, None) for a in range(side)]
    t = spark.createDataFrame([(f, h, r, "Ocean" if s else "Continent") for f, h, r, s in tiles], "fid long, elevation double, precipitation double, grouping string")
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r.fid: (round(r.water_flow, 6), round(r.water_accumulation, 6), list(r.flow_to)) for r in water.water_flow(t, e).collect()}
    want = flow_by_loop(tiles, edges)
    for f, w in want.items():
        assert got[f][2] == w[2] and got[f][:2] == pytest.approx(w[:2], abs=2e-6), f


def test_flow_of_several_worlds(spark):
    t = spark.createDataFrame([(w * 10 + k, float(5 - k), 1.0, "Continent", w) for w in range(2) for k in range(2 + w)], "fid long, elevation double, precipitation double, grouping string, world int")
    e = spark.createDataFrame([(w * 10 + a, w * 10 + b) for w in range(2) for a in range(2 + w) for b in (a - 1, a + 1) if 0 <= b < 2 + w], "src long, dst long")
    got = {r.fid: r.water_flow for r in water.water_flow(t, e, "world").collect()}
    assert got[1] == pytest.approx(2 / (2 / 10000) ** 0.25) and got[12] == pytest.approx(3 / (3 / 10000) ** 0.25)


def test_flow_of_nothing(spark):
    none = spark.createDataFrame([], "fid long, elevation double, precipitation double, grouping string")
    assert water.water_flow(none, spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("part", [50_000, 20, 7])
def test_hops_and_components_by_parts(spark, part, monkeypatch):
    """Mazes, whose shortest ways cross many parts and come back."""
    from pyspark.sql import functions as F

    from orbisframe.operators import graph

    monkeypatch.setattr(graph, "PART", part)
    rng, side = random.Random(part), 12
    kind = [rng.random() < 0.6 for _ in range(side * side)]
    edges = [(a, b) for a in range(side * side) for b in (a - 1, a + 1, a - side, a + side) if 0 <= b < side * side and abs(a % side - b % side) < 2]
    seeds = {k for k in range(side * side) if rng.random() < 0.04}
    tiles = spark.createDataFrame([(k, kind[k], k in seeds) for k in range(side * side)], "fid long, kind boolean, seed boolean")
    e = spark.createDataFrame([*edges, (0, None)], "src long, dst long")
    near = {k: [b for a, b in edges if a == k and kind[a] == kind[b]] for k in range(side * side)}
    want, wave = dict.fromkeys(seeds, 1), list(seeds)
    for k in wave:
        for n in near[k]:
            if n not in want:
                want[n] = want[k] + 1
                wave.append(n)
    got = {r.fid: r.hops for r in graph.hops(tiles, e, F.col("seed"), F.col("kind")).collect()}
    assert got == {k: want.get(k) for k in range(side * side)}
    label = {}
    for k in sorted(near, reverse=True):
        work = [] if k in label else [k]
        for n in work:
            if n not in label:
                label[n] = k
                work += near[n]
    assert {r.fid: r.label for r in graph.components(tiles, e, F.col("kind")).collect()} == label
    none = tiles.limit(0)
    assert graph.hops(none, e, F.col("seed"), F.col("kind")).count() == 0 and graph.components(none, e, F.col("kind")).count() == 0


@pytest.mark.parametrize("part", [50_000, 9])
def test_least_cost_equals_the_queue(spark, part, monkeypatch):
    """Owners and costs are those of one queue over all tiles, ties too."""
    from pyspark.sql import functions as F

    from orbisframe.operators import graph, people

    monkeypatch.setattr(graph, "PART", part)
    rng, side = random.Random(part), 11
    cost = {k: rng.choice([None, 1.0, 2.0, 2.0, 5.0]) for k in range(side * side)}
    region = {k: (k % side) // 6 for k in range(side * side)}
    edges = [(a, b) for a in range(side * side) for b in (a - 1, a + 1, a - side, a + side) if 0 <= b < side * side and abs(a % side - b % side) < 2]
    seeds = [(o, c) for o, c in enumerate(rng.sample(range(side * side), 5))]
    near = {k: sorted(b for a, b in edges if a == k and region[a] == region[b]) for k in range(side * side)}
    owner, best = people.spread(near, seeds, 14.0, lambda o, f, n: cost[n])
    tiles = spark.createDataFrame([(k, region[k], cost[k]) for k in range(side * side)], "fid long, region int, cost double")
    got = graph.least_cost(tiles, spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(seeds, "owner long, center long"), F.col("cost"), F.col("region"), 14.0)
    assert {r.fid: (r.owner, r.cost) for r in got.collect()} == {f: (owner[f], best[f]) for f in owner}
