"""Work and memory that grow with the input only, with the results of plain loops."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from orbisframe.functions.near import Near
from orbisframe.functions.rand import draw
from orbisframe.operators import biomes, climate, graph, naming, people, tables, terrain
from orbisframe.plans import registry
from orbisframe.plans.world import World


def test_nearest_tile_in_cells_of_the_sites_spacing(spark):
    rng = np.random.default_rng(5)
    xy = np.round(np.concatenate((rng.uniform(-10, 10, (400, 2)), rng.uniform(-0.5, 0.5, (300, 2)))), 2)
    p = np.round(np.concatenate((rng.uniform(-35, 35, (80, 2)), xy[:40])), 2)
    sites = spark.createDataFrame(pd.DataFrame({"fid": np.arange(len(xy)), "site_x": xy[:, 0], "site_y": xy[:, 1]}))
    points = spark.createDataFrame(pd.DataFrame({"key": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]}))
    d = ((p[:, None] - xy[None]) ** 2).sum(2)
    got = terrain.nearest_tile(points, sites, 40.0).toPandas().set_index("key").sort_index()
    assert got["fid"].tolist() == d.argmin(1).tolist() and np.allclose(got["d2"], d.min(1))
    even = spark.range(4900).select(F.col("id").alias("fid"), (F.col("id") % 70 / 10).alias("site_x"), (F.floor(F.col("id") / 70) / 10).alias("site_y"))
    points = even.select(F.col("fid").alias("key"), F.col("site_x").alias("x"), F.col("site_y").alias("y"))
    assert terrain._candidates(points, even, terrain._spacing(even)).count() < 40 * 4900


def _line(spark, n):
    tiles = spark.range(n).select(F.col("id").alias("fid"), F.when(F.col("id") < 3, "Ocean").otherwise("Continent").alias("grouping_"))
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("Tile").alias("kind"))
    return tiles, edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))


def test_shore_distance_of_the_query_ends_where_its_sql_does(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 20)
    world = type("W", (), {})()
    world.tiles, world.edges = _line(spark, 60)
    want = {0: -3, 1: -2, 2: -1} | {k: k - 2 for k in range(3, 60)}
    assert dict(map(tuple, graph.shore_distance(world.tiles, world.edges, F.col("grouping_") == "Ocean").collect())) == want
    got = dict(map(tuple, registry._QUERIES["shore_distance"][0](world).collect()))
    assert got == {k: v for k, v in want.items() if v <= 40}


def _walked(counts, mean, sd, least, key, doubled, seeds):
    """One word by plain loops over the sorted chain."""
    z = math.sqrt(-2 * math.log(1 - draw("len_a", key))) * math.cos(6.283185307179586 * draw("len_b", key))
    size, word = max(least, math.ceil(mean + sd * z)), ""
    for step in range(20):
        options = sorted((s, n) for (p, s), n in counts.items() if p == word[-1:]) or sorted((s, n) for (p, s), n in counts.items() if p == "")
        pick, total = draw("syl", key, step) * sum(n for _, n in options), 0
        for syllable, n in options:
            total += n
            if pick < total:
                break
        if word and len(word) + len(syllable) > size:
            word += syllable if len(word) < least else ""
            break
        word += syllable
    return naming.clean_word(word, doubled, seeds, key)


def test_words_are_made_in_groups_with_one_chain_each(spark, monkeypatch):
    monkeypatch.setattr(naming, "WALKS", 20)
    texts = {"a": ["alba", "berin", "corvo", "dunnmar", "elstad", "alba"], "b": ["-", "-", "x"]}
    words = spark.createDataFrame([(g, x) for g, xs in texts.items() for x in xs], "lang string, word string")
    rows = spark.range(70).select(F.col("id").alias("fid"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("lang"))
    out = naming.make_words(rows, naming.markov_chain(words, "lang", "word"), naming.length_statistics(words, "lang", "word"), "lang", "fid", naming.duplicate_letters(words, "lang", "word"), words)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in text and "_chain" not in text  # no row holds a chain
    got = {r.fid: r.word for r in out.collect()}
    assert len(got) == 70
    for fid, word in got.items():
        own = texts.get("abc "[fid % 4])
        if own is None:
            assert word is None
            continue
        counts: dict = {}
        for w in own:
            for s in naming.syllables(w):
                counts[s] = counts.get(s, 0) + 1
        n = np.array([len(w) for w in own])
        assert word == _walked(counts, n.mean(), n.std(), n.min(), fid, {"n"} if fid % 4 == 0 else set(), sorted(set(own))), fid


def test_rows_are_numbered_without_a_second_exchange(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.col("id").alias("v"))
    got = tables.number_rows(rows, ["k"], "place", 0)
    assert all(r.place == r.k and r.k == r.v * 37 % 500 for r in got.collect())
    assert not {"_k", "_p", "_b"} & set(got.columns)


def test_pairs_of_tiles_and_owners_are_dealt_over_all_cores(spark):
    w = World(spark, "/root/testdata/sf0.001")
    bio, cores = biomes.defaults(spark), spark.sparkContext.defaultParallelism
    assert people.nation_entries(w.tiles, w.nations, bio, grouping="grouping_").rdd.getNumPartitions() >= 4 * cores
    assert people.culture_entries(w.tiles, w.cultures, bio, grouping="grouping_").rdd.getNumPartitions() >= 4 * cores


def test_neighbours_in_flat_arrays():
    fid = np.array([30, 10, 20, 40])
    lists = pa.chunked_array([pa.array([[10, 99], None], pa.list_(pa.int64())), pa.array([[10, 30, 30], []], pa.list_(pa.int64()))])
    order, near = Near.of(fid, lists)
    assert order.tolist() == [1, 2, 0, 3] and [near[k] for k in range(4)] == [[], [0, 2, 2], [0], []]
    assert [Near.of(fid, lists, True)[1][k] for k in range(4)] == [[], [0, 2, 2], [0, -1], []]


def test_rain_keeps_the_visits_of_one_start_only(spark, monkeypatch):
    n = 300
    tiles = spark.range(n).selectExpr("id fid", "1.0D elevation", "90 wind", "10.0D temperature", "0.0D site_y", "if(id % 3 = 0, 'Ocean', 'Land') grouping")
    edges = spark.range(n).selectExpr("id src", f"(id + 1) % {n} dst", "'Tile' kind", "90.0D bearing")
    out = climate.precipitation(tiles, edges)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()
    state = {k: {"elevation": 1.0, "temperature": 10.0, "sea": k % 3 == 0, "factor": 4.0, "rain": 0.0} for k in range(n)}
    stack, seen = [(k, None, k) for k in range(n)], set()
    while stack:
        f, wet, start = stack.pop()
        wet = (5.0 * 120.0 * 4.0 if state[f]["sea"] else 1.0) if wet is None else wet
        to = (f + 1) % n
        if wet > 0 and (start, to) not in seen:
            seen.add((start, to))
            stack.append((to, climate._transfer(state[f], state[to], wet), start))
    assert {r.fid: r.precipitation for r in out.collect()} == {k: v["rain"] for k, v in state.items()}


def test_components_send_no_map_to_the_driver(spark, monkeypatch):
    """Tables that grow with the map are joined by shuffle in every round, however small their files are."""
    world, plans, keep = World(spark, "/root/testdata/sf0.001"), [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    k = F.when(F.col("grouping_") == "Ocean", "o").otherwise("c")
    plans.append(graph.components(world.tiles, world.edges, k)._jdf.queryExecution().executedPlan().toString())
    rounds = [p for p in plans if "label" in p]
    assert len(rounds) > 2 and not any("BroadcastHashJoin" in p for p in rounds)
