"""Seeds and places: equal tasks differ, equal seeds give equal worlds."""

import os

import pytest

from orbisframe.functions import rand
from orbisframe.operators import terrain
from orbisframe.plans.world import World
from orbisframe.world import Source, WorldMap

SF = "/root/testdata/sf0.001"


def test_streams_differ_by_seed_and_place():
    seen = [rand.stream(None), rand.stream(0), rand.stream("0", 1), rand.stream(0, "1/2"), rand.stream(0, 1, 2), rand.stream(None, "seed=0"), rand.stream(None, 0, 1)]
    assert len(set(seen)) == len(seen) - 1  # the seed 0 and a place called seed=0 are one
    assert rand.stream(None) == ""
    draws = [rand.draw(f"{rand.stream(s)}x", k) for s in range(20) for k in range(20)]
    assert len(set(draws)) == 400 and 0.4 < sum(draws) / 400 < 0.6


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("task", [{"task": "AddHill", "count": 1, "height_delta": 30}, {"task": "RandomUniform", "height_delta": "-5..=10"}, {"task": "AddRange", "count": 1, "height_delta": 30}])
def test_equal_tasks_draw_apart(spark, task):
    w = World(spark, SF)
    flat = terrain.clear(w.tiles.withColumnRenamed("grouping_", "grouping"))

    def heights(tasks, seed=1):
        return {r.fid: r.elevation for r in terrain.recipe(flat, w.edges, tasks, stream=rand.stream(seed)).select("fid", "elevation").collect()}

    one, two = heights([task]), heights([task, task])
    assert any(abs(two[k] - 2 * one[k]) > 1e-6 for k in one)
    assert heights([task]) == one
    assert heights([task], 2) != one
    assert heights([{"task": "Recipe", "recipe": [task]}]) != one  # another place


def test_worlds_of_a_seed(spark):
    def world(seed):
        w = WorldMap(spark, Source(n_tiles=40, tasks=[{"task": "RandomUniform", "height_delta": "-20..=40"}], seed=seed)).create()
        return sorted((round(r.site_x, 9), round(r.site_y, 9), r.elevation) for r in w.tiles.select("site_x", "site_y", "elevation").collect())

    a, b, c = world(1), world(1), world("two")
    assert a == b and {x[:2] for x in a}.isdisjoint(x[:2] for x in c)
