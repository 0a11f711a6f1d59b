"""A world from an empty map to named regions: the steps as commands.

``WorldMap`` holds the layers as DataFrames. Each command replaces some of
them by tables cut from their lineage; ``save`` makes a version of them in a
folder, visible at once, and ``transaction`` undoes edits that fail.
``generate`` runs everything.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbisframe.operators import biomes as B
from orbisframe.operators import climate, colors, construct, cultures, graph, lakes, layers, naming, neighbors, outlines, overlay, people, settle, tables, terrain, water
from orbisframe.functions.rand import stream
from orbisframe.operators.terrain import Limits
from orbisframe.session import cut
from orbisframe.sources import geotiff, snapshots

#: Commands and what they take; ``command_docs`` writes them as text.
COMMANDS = {
    "create": "points, triangles, tiles and neighbours of a blank map, then terrain tasks", "terrain": "terrain tasks, or a named recipe of them",
    "gen_climate": "temperature, winds, precipitation", "gen_water": "flow, lakes, rivers, shore distance, grouping, coastline",
    "gen_biome": "default biomes, their application, outlines", "gen_people": "population; cultures: founding, expansion, outlines",
    "gen_towns": "capitals, towns, ports, population", "gen_nations": "founding, expansion, normalisation, outlines",
    "gen_subnations": "seats, expansion, filling, normalisation, colours, outlines", "generate": "everything, in order",
}


def command_docs() -> str:
    """The commands as Markdown."""
    return "\n".join(["# Commands", "", "| Command | Does |", "| --- | --- |", *(f"| `{k}` | {v} |" for k, v in COMMANDS.items())])


@dataclass
class Source:
    """Where a world begins: its map, number of tiles and first tasks."""

    n_tiles: int = 10_000
    limits: Limits = Limits()
    sphere: bool = False
    tasks: list[dict] = field(default_factory=list)
    heightmap: DataFrame | None = None  # (px, py, value), row 0 in the south
    columns: int = 0
    rows: int = 0
    seed: int | str | None = None  # worlds of one seed are equal, others are independent

    @staticmethod
    def from_raster(spark: SparkSession, path: str, n_tiles: int = 10_000, band: int = 1, **more: object) -> "Source":
        """A height map's own extent, its lowest and highest value as limits."""
        rows, head = geotiff.read_geotiff(spark, path, [band])
        rows = rows.select("px", "py", "value")
        low, high = rows.agg(F.min("value"), F.max("value")).first()
        limits = head.limits(*((low, high) if low is not None else ()))
        return Source(n_tiles=n_tiles, limits=limits, heightmap=rows, columns=head.width, rows=head.height, **more)


class WorldMap:
    def __init__(self, spark: SparkSession, source: Source = Source()):
        self.spark, self.source, self.t, self.warnings, self._runs = spark, source, {}, [], 0
        self._stored: tuple = ()

    @property
    def tiles(self) -> DataFrame:
        return self.t["tiles"]

    @property
    def edges(self) -> DataFrame:
        return self.t["neighbors"]

    @property
    def inner(self) -> DataFrame:
        return self.edges.where("dst is not null")

    def stream(self, *places: object) -> str:
        """The stream of a step of this world."""
        return stream(self.source.seed, *places)

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        self.t[name] = cut(rows)
        return self.t[name]

    def fill(self, rows: DataFrame, *columns: str) -> None:
        """Columns of the tiles anew from rows by fid."""
        kept = self.tiles.drop(*columns)
        self.put("tiles", kept.join(rows.select("fid", *columns), "fid", "left"))

    def save(self, folder: str, overwrite: bool = False) -> int:
        """A new version of the world in ``folder``, complete at once; layers
        that it has already aren't written again. A world that is there is an
        error without ``overwrite``, and stays readable until the new version
        is complete; a version that somebody else made since this one was read
        is a ``ConflictError``."""
        folder = folder.rstrip("/")
        known, stored = self._stored if self._stored and self._stored[0][0] == folder else ((folder, None), {})
        if not overwrite and snapshots.versions(self.spark, folder):
            raise FileExistsError(folder)
        kept = {n: place for n, (rows, place) in stored.items() if self.t.get(n) is rows}
        version, places = snapshots.commit(self.spark, folder, self.t, kept, known[1])
        self._stored = ((folder, version), {n: (self.t[n], places[n]) for n in self.t})
        return version

    @staticmethod
    def load(spark: SparkSession, folder: str, source: Source = Source(), version: int | None = None) -> "WorldMap":
        out, folder = WorldMap(spark, source), folder.rstrip("/")
        version, places, out.t = snapshots.read(spark, folder, version)
        out._stored = ((folder, version), {n: (rows, places[n]) for n, rows in out.t.items()})
        return out

    @contextlib.contextmanager
    def transaction(self, folder: str | None = None) -> "Iterator[WorldMap]":
        """Edits that hold together: if one fails, all layers are as before.
        With a folder, the result is saved there as one version."""
        before, warnings, runs, stored = dict(self.t), list(self.warnings), self._runs, self._stored
        try:
            yield self
            if folder is not None:
                self.save(folder, overwrite=True)
        except BaseException:
            self.t, self.warnings, self._runs, self._stored = before, warnings, runs, stored
            raise

    def info(self) -> DataFrame:
        return layers.dataset_info(self.t)

    # construction and terrain

    def create(self) -> "WorldMap":
        s, lim = self.source, self.source.limits
        points = self.put("points", construct.gen_points(self.spark, s.n_tiles, lim, stream=self.stream("create"), sphere=s.sphere))
        triangles = self.put("triangles", construct.delaunay(points))
        cells = construct.voronoi(points, triangles, lim, s.sphere)
        rows = tables.number_rows(cells.drop("key"), ["site_x", "site_y"])
        rows = rows.select("fid", "site_x", "site_y", "area", "ring", F.lit(0.0).alias("elevation"), F.lit(20).alias("elevation_scaled"), F.lit("Continent").alias("grouping"))
        self.put("tiles", neighbors.with_edge(rows, lim))
        self.put("neighbors", neighbors.calc_neighbors(self.tiles, lim, s.sphere))
        limits = [("elevation-limits", f"({lim.low},{lim.high})"), ("world-shape", "Sphere" if s.sphere else "Cylinder")]
        self.put("properties", self.spark.createDataFrame(limits, "name string, value string"))
        if s.heightmap is not None:
            self.put("tiles", terrain.elevation_scale(terrain.sample_elevation(self.tiles, s.heightmap, s.columns, s.rows, lim), lim))
        return self.terrain(s.tasks)

    def terrain(self, tasks: list[dict]) -> "WorldMap":
        if tasks:
            self.put("tiles", terrain.recipe(self.tiles, self.inner, tasks, self.source.limits, stream=self.stream("terrain", self._runs)))
            self._runs += 1  # a list that is run again draws anew
        return self

    # climate, water, biomes

    def gen_climate(self, equator: float = 27.0, pole: float = -30.0, moisture: float = 1.0) -> "WorldMap":
        self.put("tiles", climate.winds(climate.temperature(self.tiles, equator, pole)))
        self.fill(climate.precipitation(self.tiles, self.edges, moisture), "precipitation")
        return self

    def gen_water(self, curve: float = 100.0, buffer: float = 2.0) -> "WorldMap":
        self.fill(water.water_flow(self.tiles, self.edges), "water_flow", "water_accumulation", "flow_to")
        filled = cut(lakes.water_fill(self.tiles, self.edges))
        flow = self.tiles.select("fid", "water_flow").join(filled, "fid")
        self.fill(flow.withColumn("water_flow", F.col("water_flow") + F.col("added_flow")), "water_flow", "lake_id", "outlet_from")
        width = layers.average_tile_area(self.tiles, self.source.limits).first().avg_area ** 0.5
        self.put("lakes", lakes.lakes_of(filled).join(outlines.lake_shapes(self.tiles, width, buffer, curve).select("fid", "rings"), "fid", "left"))
        self._rivers(curve)
        self._shore()
        self.fill(graph.grouping(self.tiles, self.edges, F.col("grouping") == "Ocean", F.col("lake_id")), "grouping", "grouping_id")
        self.put("coastlines", overlay.coast(self.tiles, F.col("grouping") == "Ocean", "grouping_id", self.source.limits, curve))
        return self

    def _rivers(self, curve: float) -> None:
        kinds = self.inner.select("src", "dst", "kind")
        flows = self.tiles.select(F.col("fid").alias("src"), F.explode("flow_to").alias("dst")).where("dst >= 0").join(kinds, ["src", "dst"])
        out = self.tiles.where("outlet_from is not null").select("fid", "outlet_from")
        segments = cut(water.river_segments(self.tiles, flows, out))
        topology = cut(water.river_topology(segments, self.tiles.select("fid", "lake_id")))
        self.put("rivers", topology.join(outlines.river_curves(segments, self.tiles, curve, self.source.limits), ["from", "to"], "left"))

    def _shore(self) -> None:
        wet = (F.col("grouping") == "Ocean") | F.col("lake_id").isNotNull()
        self.fill(graph.shore_distance(self.tiles, self.inner, wet), "shore_distance")
        near = graph.nearest_water(self.tiles, self.inner, wet).select(F.col("src").alias("fid"), F.col("harbor").alias("harbor_tile_id"), "water_count")
        self.fill(near, "harbor_tile_id", "water_count")

    def gen_biome(self, glacier: float | None = None, wetland: float | None = None, curve: float = 100.0) -> "WorldMap":
        biomes = self.put("biomes", B.defaults(self.spark, glacier, wetland))
        self.put("tiles", B.apply(self.tiles, self.t["lakes"], biomes))
        return self._outline("biome", "biomes", "name", curve)

    def _outline(self, column: str, layer: str, key: str, curve: float) -> "WorldMap":
        """Rings of a layer's regions, reaching over the shoreline, with
        shared borders curved once, inside the map."""
        theme = settle.dissolve_theme(self.tiles, self.inner, column)
        rings = overlay.region_outlines(self.tiles.select("fid", "ring").join(theme.withColumn("theme", F.col("theme").cast("string")), "fid"), "theme", self.source.limits, curve)
        rows = self.t[layer].drop("rings")
        self.put(layer, rows.join(rings.select("theme", "rings"), rows[key].cast("string") == F.col("theme"), "left").drop("theme"))
        return self

    # people, towns, nations, subnations

    def gen_people(self, sources: list[dict], count: int = 15, variance: float = 1.0, threshold: float = 10.0, factor: float = 1.0, curve: float = 100.0) -> "WorldMap":
        self.put("tiles", people.population(self.tiles, self.t["biomes"], self.t["lakes"], threshold))
        flags = self.t["biomes"].select(F.col("name").alias("biome"), "supports_nomadic", "supports_hunting")
        harbor = self.tiles.select(F.col("fid").alias("harbor_tile_id"), F.col("lake_id").alias("_l"))
        size = self.t["lakes"].select(F.col("fid").alias("_l"), F.col("size").alias("neighboring_lake_size"))
        ready = self.tiles.join(F.broadcast(flags), "biome", "left").join(harbor.join(size, "_l").drop("_l"), "harbor_tile_id", "left")
        lim = self.source.limits
        found, more = cultures.generate_cultures(ready, sources, count, lim.width, lim.height, variance, threshold, stream=self.stream("people"))
        self.warnings += more
        made = cut(found.withColumn("culture_key", F.col("fid").cast("int")))
        self.put("cultures", colors.random_colors(made, stream=self.stream("people")))
        area = layers.average_tile_area(self.tiles, lim).first().avg_area
        spread = people.expand_cultures(self.tiles, self.inner, made, self.t["biomes"], 10000.0 / area * factor, threshold)
        self.fill(spread.withColumn("culture_key", F.col("owner").cast("int")), "culture_key")
        return self._outline("culture_key", "cultures", "culture_key", curve)

    def names(self, rows: DataFrame, words: DataFrame, step: str, key: str = "fid") -> DataFrame:
        """``rows`` (with namer) and ``word``, by each namer's trained chain.
        ``words``: namer, word. Rows without a namer take the first one."""
        default = words.agg(F.min("namer").alias("_first"))
        rows = rows.crossJoin(F.broadcast(default)).withColumn("namer", F.coalesce("namer", "_first")).drop("_first")
        return naming.make_words(rows, naming.markov_chain(words, "namer", "word"), naming.length_statistics(words, "namer", "word"), "namer", key, naming.duplicate_letters(words, "namer", "word"), words, self.stream(step))

    def gen_towns(self, words: DataFrame, capitals: int | None = None, towns: int | None = None, threshold: float = 10.0) -> "WorldMap":
        lim = self.source.limits
        n = settle.town_counts(lim.width * lim.height, self.tiles.where("habitability > 0").count(), capitals, towns)
        rows = settle.generate_towns(self.tiles, *n, stream=self.stream("towns")).join(self.tiles.select(F.col("fid").alias("tile_id"), "culture_key", "grouping_id"), "tile_id")
        namer = self.t["cultures"].select("culture_key", "namer")
        named = self.names(rows.join(F.broadcast(namer), "culture_key", "left"), words, "towns").withColumnRenamed("word", "name").drop("namer")
        self.put("towns", named)
        self.fill(self.t["towns"].select(F.col("tile_id").alias("fid"), F.col("fid").alias("town_id")), "town_id")
        more = settle.populate_towns(self.t["towns"], self.tiles, self.t["lakes"], threshold)
        self.put("towns", self.t["towns"].drop("population", "is_port", "x", "y").join(more, "fid"))
        return self

    def gen_nations(self, words: DataFrame, variance: float = 1.0, factor: float = 1.0, threshold: float = 10.0, curve: float = 100.0) -> "WorldMap":
        rows = settle.generate_nations(self.t["towns"], self.t["cultures"], variance, self.stream("nations"))
        namer = self.t["cultures"].select("culture_key", "namer")
        named = self.names(rows.join(F.broadcast(namer), "culture_key", "left"), words, "nations").withColumnRenamed("word", "name")
        named = naming.state_names(named, stream=self.stream("nations")).drop("name", "namer").withColumnRenamed("state", "name")
        nations = self.put("nations", colors.random_colors(cut(named), stream=self.stream("nations")))
        area = layers.average_tile_area(self.tiles, self.source.limits).first().avg_area
        spread = people.expand_nations(self.tiles, self.inner, nations, self.t["biomes"], 5000.0 / area * factor, threshold)
        self.fill(spread.withColumn("nation_id", F.col("owner")), "nation_id")
        self.put("tiles", settle.normalize_nations(self.tiles, self.inner, self.t["towns"]))
        return self._outline("nation_id", "nations", "fid", curve)

    def gen_subnations(self, words: DataFrame, percentage: float = 20.0, curve: float = 100.0) -> "WorldMap":
        t = self.tiles
        towns = self.t["towns"].join(t.where("nation_id is not null").select(F.col("fid").alias("tile_id"), "nation_id"), "tile_id")
        namer = self.t["cultures"].select("culture_key", "namer")
        made = self.names(towns.join(F.broadcast(namer), "culture_key", "left"), words, "subnations")
        states = naming.state_names(made.select("fid", F.col("word").alias("name")), stream=self.stream("subnations")).select("fid", F.col("state").alias("_made"))
        subs = cut(settle.generate_subnations(cut(towns.join(states, "fid")), self.t["nations"], self.t["cultures"], F.col("_made"), percentage, self.stream("subnations")))
        area = layers.average_tile_area(t, self.source.limits).first().avg_area
        limit = settle.subnation_cost_limit(area, percentage)
        cost = people.subnation_cost(F.col("elevation_scaled"), F.col("area"), F.col("shore_distance"))
        seeds = subs.select(F.col("fid").alias("owner"), F.col("center_tile_id").alias("center"))
        reached = graph.least_cost(t.where("nation_id is not null"), self.inner, seeds, cost, F.col("nation_id"), limit)
        self.fill(reached.withColumn("subnation_id", F.col("owner")), "subnation_id")
        more = cut(settle.fill_empty_subnations(self.tiles, self.inner, limit))
        self.fill(more, "subnation_id")
        self._join_founded(subs, more)
        self.put("tiles", settle.normalize_subnations(self.tiles, self.inner, self.t["subnations"].select(F.col("center_tile_id").alias("fid"))))
        shades = colors.subnation_colors(self.t["subnations"], self.t["nations"], self.stream("subnations"))
        self.put("subnations", self.t["subnations"].drop("color").join(shades, "fid", "left"))
        return self._outline("subnation_id", "subnations", "fid", curve)

    def _join_founded(self, subs: DataFrame, filled: DataFrame) -> None:
        """Subnations founded while filling get ids after the others, on their
        tiles too; they are called after their seat, or after their nation."""
        new = filled.where("subnation_id < 0").groupBy("subnation_id").agg(F.first("seat_town_id", True).alias("seat_town_id"))
        new = new.withColumn("center_tile_id", -F.col("subnation_id") - 1).join(self.tiles.select(F.col("fid").alias("center_tile_id"), "nation_id", "culture_key"), "center_tile_id")
        top = subs.agg(F.coalesce(F.max("fid"), F.lit(0))).first()[0]
        new = cut(tables.number_rows(new, ["center_tile_id"], "fid", top + 1))
        town = self.t["towns"].select(F.col("fid").alias("seat_town_id"), F.col("name").alias("_town"))
        nation = self.t["nations"].select(F.col("fid").alias("nation_id"), F.col("name").alias("_nation"), "color")
        rows = new.join(town, "seat_town_id", "left").join(nation, "nation_id", "left").withColumn("name", F.coalesce("_town", "_nation")).withColumn("type_", F.lit("Generic"))
        self.put("subnations", subs.unionByName(rows.select(*subs.columns)))
        ids = new.select(F.col("subnation_id").alias("_old"), F.col("fid").alias("_new"))
        t = self.tiles.join(ids, F.col("subnation_id") == F.col("_old"), "left")
        self.put("tiles", t.withColumn("subnation_id", F.coalesce("_new", "subnation_id")).drop("_old", "_new"))

    def generate(self, sources: list[dict], words: DataFrame, cultures_count: int = 15, capitals: int | None = None, towns: int | None = None) -> "WorldMap":
        """Everything in order. ``sources``: culture sets as
        ``read_cultures`` reads them; ``words``: (namer, word)."""
        self.create().gen_climate().gen_water().gen_biome()
        return self.gen_people(sources, cultures_count).gen_towns(words, capitals, towns).gen_nations(words).gen_subnations(words)
