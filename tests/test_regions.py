"""Geometry, lakes, founding, naming, colours, layer tables and whole worlds."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisframe.operators import colors, cultures, lakes, layers, naming, outlines
from orbisframe.plans import more, registry
from orbisframe.plans.world import World

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
NAMES = [n for n, (f, sql) in registry._QUERIES.items() if f.__module__ == more.__name__ and sql]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "supplier", "nation", "orders", "documents"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr(tuple(r[cols.index(c)] for c in df.columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


def _fill(heights, rain, side, warm=10.0, sea=()):
    near = {k: [] for k in range(side * side)}
    for a in near:
        for b in near:
            if a != b and abs(a // side - b // side) <= 1 and abs(a % side - b % side) <= 1:
                near[a].append(b)
        if a // side in (0, side - 1) or a % side in (0, side - 1):
            near[a].append(lakes.OFF_MAP)
    down = {}
    for a, to in near.items():
        low = min(float("-inf") if n == lakes.OFF_MAP else heights[n] for n in to)
        down[a] = [n for n in to if (float("-inf") if n == lakes.OFF_MAP else heights[n]) == low] if low <= heights[a] else []
    f = lakes.Filler(dict(enumerate(heights)), dict.fromkeys(near, warm), set(sea), near, down)
    f.run(rain, len(near))
    return f


def test_water_rises_to_the_rim_and_runs_over():
    # a pit of 1 in a plain of 9 with a notch of 5; one side falls off the map
    h = [9.0] * 25
    h[12], h[13], h[14] = 1.0, 5.0, 2.0
    little = _fill(h, [(12, 6.0)], 5)
    evap = ((700 * (10 + 0.006 * 1.0)) / 50 + 75) / 70
    assert little.lake[12].level == pytest.approx(1.0 + 6.0 - evap if 6.0 - evap < 4.0 else 5.0) and not little.lake[12].outlets
    much = _fill(h, [(12, 100.0)], 5)
    basin = much.lake[12]
    assert basin.level == 5.0 and sorted(basin.tiles) == [12, 13] and [n for _, n in basin.outlets] == [14] and much.from_lake == {14: 13}
    assert 0 < much.added[14] < 100.0 and basin.flow == 100.0 and basin.bottom == 1.0
    again = _fill(h, [(12, 50.0), (12, 100.0)], 5)
    assert again.added[14] == pytest.approx(much.added[14] + 50.0)


def test_lakes_of_one_height_join():
    h = [9.0] * 49
    h[23], h[24], h[25] = 3.0, 6.0, 3.0  # two pits with a saddle of 6 between them
    f = _fill(h, [(23, 200.0), (25, 200.0)], 7)
    assert f.lake[23] is f.lake[25] and {23, 24, 25} <= set(f.lake[23].tiles) and f.lake[23].bottom == 3.0
    assert not f.cut_off and len({id(b) for b in f.lake.values()}) == 1


def test_lakes_in_flat_arrays():
    """Numbered tiles in flat arrays give the lakes that tables of tiles give, without a table of tiles or of sides."""
    rng = random.Random(4)
    h = [round(rng.uniform(0, 60), 1) for _ in range(400)]
    rain = [(k, rng.uniform(1, 90)) for k in rng.sample(range(400), 60)]
    want = _fill(h, rain, 20, sea=(7, 8, 28, 190))
    near, down = ([want.__dict__[c][k] for k in range(400)] for c in ("near", "down"))
    flat = lakes.Filler(memoryview(np.array(h)), memoryview(np.full(400, 10.0)), bytes(k in (7, 8, 28, 190) for k in range(400)), near, down, 400)
    flat.run(rain, 400)
    told = lambda b: b and (b.name, b.level, b.bottom, b.flow, b.rim, list(b.tiles), b.outlets)
    assert [told(b) for b in flat.lake] == [told(want.lake.get(k)) for k in range(400)] and len(want.lake) > 20
    assert list(flat.added) == [want.added.get(k, 0.0) for k in range(400)] and flat.from_lake == want.from_lake and flat.cut_off == want.cut_off
    assert all(b is None or b.shore is None or b.shore.itemsize == 8 for b in flat.lake)


def test_sea_takes_water():
    f = _fill([5.0, 4.0, 3.0, 5.0, 4.0, -5.0, 5.0, 4.0, 3.0], [(4, 10.0), (5, 10.0)], 3, sea=(5,))
    assert not f.lake or all(5 not in b.tiles for b in f.lake.values())


def test_lake_rows(spark):
    h = [9.0] * 25
    h[12], h[13], h[14] = 1.0, 5.0, 2.0
    tiles = spark.createDataFrame([(k, x, 10.0, 100.0 if k == 12 else 0.0, [], "Continent") for k, x in enumerate(h)], "fid long, elevation double, temperature double, water_accumulation double, flow_to array<long>, grouping string")
    near = [(a, b) for a in range(25) for b in range(25) if a != b and abs(a // 5 - b // 5) <= 1 and abs(a % 5 - b % 5) <= 1]
    edges = spark.createDataFrame(near, "src long, dst long")
    filled = lakes.water_fill(tiles, edges)
    # no way out: both pits end in one lake, called after the one that took in the other
    assert {r.fid for r in filled.where("lake_id = 14").collect()} >= {12, 13, 14} and filled.count() == 25
    (lake,) = lakes.lakes_of(filled).collect()
    assert lake.elevation >= 5.0 and lake.bottom_elevation == 1.0 and lake.type_ in ("Salt", "Dry") and not lake.has_outlet
    two = tiles.withColumn("world", F.lit(1)).unionByName(tiles.withColumn("world", F.lit(2)))
    assert lakes.water_fill(two, edges, world="world").count() == 50


def test_borders_are_shared_after_curving(spark):
    """Regions and the outside keep covering the map: areas add up to it."""
    w = World(spark, SF)
    t = registry.rings(w).withColumn("theme", F.coalesce(F.col("nation_id"), F.lit(99)).cast("string"))
    straight = outlines.curvify(t, "theme", None).agg(F.sum("area")).first()[0]
    lines = outlines.shared_borders(t, "theme", 100.0)
    inner = lines.where("right is not null")
    assert abs(straight - 64800) < 1e-6 and inner.count() > 5
    assert inner.agg(F.sum("length")).first()[0] != pytest.approx(outlines.shared_borders(t, "theme", None).where("right is not null").agg(F.sum("length")).first()[0])
    whole = outlines.curvify(t, "theme", 100.0).collect()
    ends = [tuple(map(tuple, (r.line[0], r.line[-1]))) for r in lines.collect()]
    assert len(whole) == t.select("theme").distinct().count() and all(a in [x for e in ends for x in e] for a, _ in ends)


def test_rings_touching_in_a_point_stay_apart():
    square = lambda x, y: [((x, y), (x + 1, y)), ((x + 1, y), (x + 1, y + 1)), ((x + 1, y + 1), (x, y + 1)), ((x, y + 1), (x, y))]
    rings = outlines.link_rings(square(0.0, 0.0) + square(1.0, 1.0))
    assert sorted(map(outlines.signed_area, rings)) == [1.0, 1.0]
    assert outlines.simplify_ring([(0, 0), (1, 0.01), (2, 0), (2, 2), (0, 2)], 0.1) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert 0 < outlines.signed_area(outlines.shrink_ring([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], 0.5)) < 16
    ring = outlines.curve_ring([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], 100.0)
    assert {(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)} <= set(ring) and 16 < outlines.signed_area(ring) < math.pi * 8.5


def test_reject_sample_takes_likely_ones():
    items = [(k, 1.0 if k < 3 else 1e-9) for k in range(10)]
    assert sorted(cultures.weighted_reject_sample(items, 3)) == [0, 1, 2]
    assert sorted(cultures.weighted_reject_sample(items, 99)) == list(range(10)) and cultures.weighted_reject_sample([], 3) == []


def test_cultures_keep_apart(spark):
    rows = [(k, float(k % 20) * 18 - 180, float(k // 20) * 18 - 90, random.Random(k).random() * 30, 10) for k in range(200)]
    base = spark.createDataFrame(rows, "fid long, site_x double, site_y double, habitability double, population int")
    t = base.selectExpr("*", "30 as elevation_scaled", "false as supports_nomadic", "false as supports_hunting", "cast(null as int) as water_count", "cast(null as int) as neighboring_lake_size", "'Continent' as grouping", "0D as water_flow", "1 as shore_distance")
    sources = [{"name": "Same", "namer": "n", "preferences": "Habitability"}] * 5
    out, warnings = cultures.generate_cultures(t, sources, 4)
    got = out.orderBy("fid").collect()
    assert [r.name for r in got] == ["Same I", "Same II", "Same III", "Same IV"] and not warnings and len({r.center_tile_id for r in got}) == 4
    median = sorted(r[3] for r in rows)[100]
    assert all(rows[r.center_tile_id][3] >= median for r in got)
    few, warnings = cultures.generate_cultures(t.where("fid < 60"), sources, 5)
    assert few.count() == 2 and len(warnings) == 1


@pytest.mark.parametrize(("raw", "want"), [("balloon", "balon"), ("aeron' ", "eron"), ("x y abc", "xyabc"), ("ab- cd", "ab-cd"), ("annna", "anna")])
def test_words_are_cleaned(raw, want):
    assert naming.clean_word(raw, frozenset("n")) == want
    assert naming.clean_word("-", seeds=["alba"]) == "alba"


def test_markov_words_are_walks(spark):
    words = spark.createDataFrame([("a", x) for x in ("alba", "berin", "corvo", "dunmar", "elstad")], "lang string, word string")
    chain = naming.markov_chain(words, "lang", "word")
    total = {(r.prev, r.syllable): r.n for r in chain.collect()}
    plain: dict = {}
    for w in ("alba", "berin", "corvo", "dunmar", "elstad"):
        for key in naming.syllables(w):
            plain[key] = plain.get(key, 0) + 1
    assert total == plain
    rows = spark.range(50).selectExpr("id as fid", "'a' as lang")
    out = naming.make_words(rows, chain, naming.length_statistics(words, "lang", "word"), "lang", "fid", seeds=words).collect()
    assert all(r.word and set(r.word) <= set("albaberincorvodunmarelstad") for r in out) and len({r.word for r in out}) > 5


def test_state_suffixes(spark):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(("Heidelberg", "Kingston", "Roma", "Boa", "Mali"))], "fid long, name string")
    plain = {r.name: r.state for r in naming.state_names(rows, suffix="NoSuffix").collect()}
    assert plain == {"Heidelberg": "Heidel", "Kingston": "Kings", "Roma": "Roma", "Boa": "Boa", "Mali": "Mali"}
    got = {r.name: r.state for r in naming.state_names(rows, (("ForcePrefix", "New "),), ("Suffix", "istan")).collect()}
    assert all(v.startswith("New ") and (v.endswith("istan") or v[4:] in plain.values()) for v in got.values()) and any(v.endswith("istan") for v in got.values())
    with pytest.raises(Exception, match="unknown namer"):
        naming.namer_lookup(spark.createDataFrame([("x",)], "namer string"), spark.createDataFrame([("a", 1)], "name string, k int")).collect()


def test_colors_lie_in_their_bounds(spark):
    rows = colors.random_colors(spark.range(60).withColumnRenamed("id", "fid")).collect()
    assert len({r.color for r in rows}) == 60 and all(len(r.color) == 7 for r in rows)
    got = spark.createDataFrame([("#FF0000",), ("#00FF00",), ("#0000FF",), ("#808080",)], "c string").select(colors.hue_of(F.col("c")).alias("h")).collect()
    assert [r.h for r in got] == [0.0, 120.0, 240.0, 0.0]
    back = spark.range(0, 360, 7).select(F.col("id").cast("double").alias("h")).select("h", colors.hue_of(colors.hex_color(F.col("h"), F.lit(1.0), F.lit(1.0))).alias("b")).collect()
    assert all(abs(r.h - r.b) < 0.5 for r in back)
    light = spark.range(0, 360).select(*colors.value_range(F.col("id").cast("double"), F.lit(0.4), "Light")).collect()
    assert all(0.5 <= low <= high == 1.0 for low, high in light)


def test_layer_tables(spark):
    rows = layers.typed_rows(spark, "towns", [{"name": "A", "population": 3}])
    assert rows.first().name == "A" and rows.first().is_port is None
    with pytest.raises(ValueError, match="no column"):
        layers.typed_rows(spark, "towns", [{"nam": "A"}])
    t = spark.createDataFrame([(1, "x"), (2, "y")], "fid long, name string")
    assert layers.point_lookup(t, 2).name == "y"
    with pytest.raises(KeyError):
        layers.point_lookup(t, 9)
    assert "## lakes" in layers.schema_docs() and layers.json_schemas()["tiles"]["properties"]["neighbors"]["items"]["type"] == ["object", "null"]
    assert layers.version(spark)["spark"] == spark.version and "geopackage" in layers.drivers(spark)
    assert [r.fid for r in layers.index_by_fid(t.orderBy(F.desc("fid"))).collect()] == [1, 2]
    seen = spark.sparkContext.accumulator(0)
    layers.for_each(t, lambda r: seen.add(r.fid))
    assert seen.value == 3


def test_configuration_round_trip(spark, tmp_path):
    from orbisframe.sources import config

    (tmp_path / "Old.txt").write_text("alba\n\nberin\n")
    (tmp_path / "a.json").write_text('[{"name":"Old","method":{"ListPicker":["X"]}},{"name":"M","method":{"Markov":{"duplicatable_letters":"nl","seed_words":["anna"]}},"state_name":[{"ForceVowel":"o"}],"state_suffix":"NoSuffix"}]')
    got = config.read_namers(spark, [str(tmp_path / "Old.txt"), str(tmp_path / "a.json")])
    assert {r.name: r.method for r in got.collect()} == {"Old": "ListPicker", "M": "Markov"}
    (tmp_path / "b.json").write_text(config.namer_json(got))
    assert sorted(map(tuple, config.read_namers(spark, [str(tmp_path / "b.json")]).collect())) == sorted(map(tuple, got.collect()))
    (tmp_path / "c.json").write_text('[{"name":"A","count":2,"preferences":{"Temperature":5}}]')
    sets = config.read_cultures(spark, str(tmp_path / "c.json"))
    (tmp_path / "d.json").write_text(config.culture_json(sets))
    assert sorted(map(tuple, config.read_cultures(spark, str(tmp_path / "d.json")).collect())) == sorted(map(tuple, sets.collect()))
    assert config.task_json({"fr": 2, "task": "Smooth"}) == '{"task": "Smooth", "fr": 2}' and config.read_word_lists(spark, []).count() == 0
    t = spark.range(3)
    assert config.write_layer(t, str(tmp_path), "points").count() == 3
    with pytest.raises(Exception, match="exist"):
        config.write_layer(t, str(tmp_path), "points")


def test_expansion_by_type_equals_costs_by_pair(spark):
    """One row a tile gives what a row for each pair of owner and tile gives;
    for nations where all tiles have the nation's culture."""
    from orbisframe.operators import biomes, people

    w = World(spark, SF)
    b = biomes.defaults(spark)
    seeds = w.cultures.select(F.col("culture_key").cast("long").alias("owner"), F.col("center_tile_id").alias("center"))
    want = people.expand(people.culture_entries(w.tiles, w.cultures, b, grouping="grouping_"), w.edges, seeds, 4000.0)
    got = people.expand_cultures(w.tiles, w.edges, w.cultures, b, 4000.0, grouping="grouping_")
    rows = lambda df: sorted((r.fid, r.owner, round(r.cost, 6)) for r in df.collect())
    assert rows(got) == rows(want) and got.count() > 100
    t, n = w.tiles.withColumn("culture_key", F.lit(1)), w.nations.withColumn("culture_key", F.lit(1))
    seeds = n.select(F.col("fid").alias("owner"), F.col("center_tile_id").alias("center"))
    want = people.expand(people.nation_entries(t, n, b, grouping="grouping_"), w.edges, seeds, 20000.0)
    assert rows(people.expand_nations(t, w.edges, n, b, 20000.0, grouping="grouping_")) == rows(want)


def test_a_whole_world(spark, tmp_path):
    from orbisframe.world import COMMANDS, Source, WorldMap, command_docs

    tasks = [{"task": "RandomUniform", "height_delta": "-30..45"}, {"task": "Smooth", "fr": 2}, {"task": "FillOcean"}]
    w = WorldMap(spark, Source(n_tiles=150, tasks=tasks))
    sources = [{"name": n, "namer": n, "preferences": p} for n, p in (("A", "Habitability"), ("B", {"Negate": "Elevation"}))]
    words = spark.createDataFrame([(n, x) for n in "AB" for x in ("alba", "berin", "corvo", "dunmar", "elstad", "faros")], "namer string, word string")
    w.generate(sources, words, 2, 3, 10)
    n = w.tiles.count()
    assert abs(w.tiles.agg(F.sum("area")).first()[0] - 64800) < 1e-6 and w.tiles.select("fid").distinct().count() == n
    assert w.edges.join(w.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).count() == w.edges.count()
    assert w.t["nations"].count() == 3 and w.t["towns"].count() == 13 and w.t["subnations"].count() >= 3
    owned = w.tiles.where("nation_id is not null and subnation_id is null").count()
    assert owned == 0 and w.tiles.where("subnation_id is not null").join(w.t["subnations"].select(F.col("fid").alias("subnation_id")), "subnation_id", "left_anti").count() == 0
    assert w.tiles.where("biome is null or temperature is null or grouping is null").count() == 0
    w.save(str(tmp_path / "w"))
    again = WorldMap.load(spark, str(tmp_path / "w"))
    assert again.tiles.count() == n and set(again.t) == set(w.t)
    with pytest.raises(FileExistsError):
        w.save(str(tmp_path / "w"))
    assert all(c in command_docs() for c in COMMANDS)
