"""The layers of a world: their schemas, typed rows, projections, and what
can be said about them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orbisframe.operators.tables import insert_rows
from orbisframe.operators.terrain import Limits

_NEIGHBOR = "struct<kind:string,id:bigint,edge:string>"
_NEIGHBORS = "array<struct<kind:string,id:bigint,edge:string,bearing:double>>"

# Layers with their geometry and columns; every layer has a fid.
LAYERS: dict[str, tuple[str, str]] = {
    "tiles": ("Polygon", f"site_x double, site_y double, area double, elevation double, elevation_scaled int, grouping string, grouping_id bigint, temperature double, wind int, precipitation double, water_flow double, water_accumulation double, lake_id bigint, flow_to array<{_NEIGHBOR}>, shore_distance int, harbor_tile_id {_NEIGHBOR}, water_count int, biome string, habitability double, population int, culture string, town_id bigint, nation_id bigint, subnation_id bigint, outlet_from {_NEIGHBOR}, neighbors {_NEIGHBORS}, edge string"),
    "biomes": ("MultiPolygon", "name string, habitability int, criteria string, movement_cost int, supports_nomadic boolean, supports_hunting boolean, color string"),
    "cultures": ("MultiPolygon", "name string, namer string, type_ string, expansionism double, center_tile_id bigint, color string"),
    "towns": ("Point", "name string, culture string, is_capital boolean, tile_id bigint, grouping_id bigint, population int, is_port boolean"),
    "nations": ("MultiPolygon", "name string, culture string, center_tile_id bigint, type_ string, expansionism double, capital_town_id bigint, color string"),
    "subnations": ("MultiPolygon", "name string, culture string, center_tile_id bigint, type_ string, seat_town_id bigint, nation_id bigint, color string"),
    "rivers": ("MultiLineString", f"from_tile_id bigint, from_type string, from_flow double, to_tile_id {_NEIGHBOR}, to_type string, to_flow double"),
    "lakes": ("MultiPolygon", "elevation double, type_ string, flow double, size int, temperature double, evaporation double"),
    "coastlines": ("Polygon", ""), "oceans": ("Polygon", ""),
    "properties": ("none", "name string, value string"),
    "points": ("Point", ""), "triangles": ("Polygon", ""),
}

#: What each step reads of the tiles: nothing else has to be there, or is scanned.
ENTITIES: dict[str, tuple[str, ...]] = {
    "neighbors": ("fid", "site_x", "site_y", "ring"), "terrain": ("fid", "site_x", "site_y", "elevation", "elevation_scaled", "grouping"),
    "temperature": ("fid", "site_y", "elevation", "grouping"), "winds": ("fid", "site_y"),
    "precipitation": ("fid", "site_y", "elevation", "wind", "temperature", "grouping"), "water_flow": ("fid", "elevation", "precipitation", "grouping"),
    "water_fill": ("fid", "elevation", "temperature", "water_accumulation", "flow_to", "grouping"), "rivers": ("fid", "water_flow", "lake_id"),
    "shore_distance": ("fid", "site_x", "site_y", "grouping", "lake_id"), "grouping": ("fid", "grouping", "lake_id"),
    "biomes": ("fid", "temperature", "precipitation", "water_flow", "grouping", "lake_id"),
    "population": ("fid", "area", "biome", "elevation_scaled", "water_flow", "shore_distance", "water_count", "harbor_tile_id", "lake_id", "grouping"),
    "culture_expansion": ("fid", "area", "biome", "elevation_scaled", "water_flow", "shore_distance", "lake_id", "grouping"),
    "towns": ("fid", "site_x", "site_y", "habitability", "grouping_id"), "nation_expansion": ("fid", "area", "biome", "culture_key", "elevation_scaled", "habitability", "water_flow", "shore_distance", "lake_id", "grouping"),
    "nation_normalize": ("fid", "grouping", "town_id", "nation_id"), "subnation_expansion": ("fid", "area", "elevation_scaled", "shore_distance", "nation_id"),
    "empty_subnations": ("fid", "area", "population", "shore_distance", "nation_id", "subnation_id", "town_id"),
    "subnation_normalize": ("fid", "grouping", "town_id", "nation_id", "subnation_id"),
}


def schema(layer: str) -> StructType:
    """The layer's columns: fid first, its geometry as WKB last."""
    geometry, columns = LAYERS[layer]
    return StructType.fromDDL(", ".join(x for x in ("fid bigint", columns, "" if geometry == "none" else "geom binary") if x))


def project(rows: DataFrame, entity: str, **computed: Column) -> DataFrame:
    """The columns that a step reads (see ``ENTITIES``), and computed ones."""
    return rows.select(*ENTITIES[entity], *[c.alias(n) for n, c in computed.items()])


def entity_rows(rows: DataFrame, entity: str) -> Iterable[Row]:
    """A projection's rows one by one on the driver, a partition at a time."""
    return project(rows, entity).toLocalIterator()


def index_by_fid(rows: DataFrame) -> DataFrame:
    """Rows in the order of their fid: a range sort."""
    return rows.orderBy("fid")


def for_each(rows: DataFrame, call: Callable[[Row], None]) -> None:
    """Call back for every row, on the executors, in the order of each
    partition; a lost task's rows are called again."""
    rows.foreachPartition(lambda part: [call(r) for r in part] and None)


def typed_rows(spark: SparkSession, layer: str, rows: list[dict]) -> DataFrame:
    """Rows of a layer from dictionaries: columns that aren't given are null,
    unknown ones are an error. The fid is the layer's to give."""
    kind = StructType([f for f in schema(layer) if f.name != "fid"])
    for r in rows:
        if more := set(r) - set(kind.fieldNames()):
            raise ValueError(f"{layer} has no column {sorted(more)}")
    return spark.createDataFrame([tuple(r.get(c) for c in kind.fieldNames()) for r in rows], kind)


def add_struct(rows: DataFrame, layer: str, new: list[dict], order: list[str] | None = None) -> DataFrame:
    """``rows`` with typed rows after them, numbered on from the largest fid
    in the order given."""
    typed = typed_rows(rows.sparkSession, layer, new)
    if order is None:
        order, typed = ["_n"], typed.withColumn("_n", F.monotonically_increasing_id())
    return insert_rows(rows, typed.select(*order, *[c for c in typed.columns if c not in order])).select(*rows.columns)


def point_lookup(rows: DataFrame, fid: int, entity: str | None = None) -> Row:
    """The row of that fid, or its projection; there must be one."""
    got = (rows if entity is None else project(rows, entity)).where(F.col("fid") == fid).take(1)
    if not got:
        raise KeyError(f"no row {fid}")
    return got[0]


def lookup_many(rows: DataFrame, fids: list[int], *columns: str) -> DataFrame:
    return rows.where(F.col("fid").isin(fids)).select("fid", *columns)


def is_ocean(grouping: Column) -> Column:
    return grouping == "Ocean"


def is_water(grouping: Column) -> Column:
    return grouping.isin("Ocean", "Lake")


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def layer_extent(vertices: DataFrame) -> DataFrame:
    """One row: west, south, width, height of all vertices (x, y)."""
    x, y = F.min("x"), F.min("y")
    return vertices.agg(x.alias("west"), y.alias("south"), (F.max("x") - x).alias("width"), (F.max("y") - y).alias("height"))


def layer_size(vertices: DataFrame) -> DataFrame:
    return layer_extent(vertices).select("width", "height")


def average_tile_area(tiles: DataFrame, lim: Limits = Limits(), sphere: bool = False) -> DataFrame:
    """One row: number of tiles, and the map's area for each."""
    whole = lim.width * lim.height
    if sphere:
        from orbisframe.functions.geo import sphere_ring_area

        east, north = lim.west + lim.width, lim.south + lim.height
        whole = sphere_ring_area([(lim.west, lim.south), (east, lim.south), (east, north), (lim.west, north)])
    return tiles.agg(F.count("*").alias("n"), (F.lit(float(whole)) / F.count("*")).alias("avg_area"))


def schema_docs(layers: Iterable[str] = tuple(LAYERS)) -> str:
    """The layers as Markdown: one table each."""
    out = ["# Layers of a world file", ""]
    for name in layers:
        out += [f"## {name}", "", f"Geometry: {LAYERS[name][0]}", "", "| Column | Type |", "| --- | --- |"]
        out += [f"| `{f.name}` | {f.dataType.simpleString()} |" for f in schema(name)] + [""]
    return "\n".join(out)


def json_schemas(layers: Iterable[str] = tuple(LAYERS)) -> dict[str, dict]:
    """A JSON schema of each layer's rows."""
    kinds = {"bigint": "integer", "int": "integer", "double": "number", "boolean": "boolean", "string": "string", "binary": "string"}

    def of(t) -> dict:
        d = json.loads(t.json()) if t.simpleString().startswith(("array", "struct")) else t.simpleString()
        if isinstance(d, str):
            return {"type": [kinds[d], "null"]}
        if d["type"] == "array":
            return {"type": ["array", "null"], "items": of(t.elementType)}
        return {"type": ["object", "null"], "properties": {f.name: of(f.dataType) for f in t}}

    return {n: {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": n, "type": "object", "properties": {f.name: of(f.dataType) for f in schema(n)}} for n in layers}


def dataset_info(tables: dict[str, DataFrame]) -> DataFrame:
    """(layer, column, type) of a world's tables."""
    rows = [(n, f.name, f.dataType.simpleString()) for n, df in tables.items() for f in df.schema]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "layer string, column string, type string")


def version(spark: SparkSession) -> dict[str, str]:
    from orbisframe import __version__

    return {"orbisframe": __version__, "spark": spark.version}


def drivers(spark: SparkSession) -> list[str]:
    """Formats that layers can be read from and written to here."""
    from orbisframe.sources.geopackage import GeoPackage

    spark.dataSource.register(GeoPackage)
    return ["ascii-grid", GeoPackage.name(), "json", "parquet", "text"]
