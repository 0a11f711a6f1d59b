"""Lookups between layers. References are ids, or names where a layer is
configuration (biomes, cultures, nations' themes); configuration is broadcast,
layers that grow with the map are joined as the engine decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_reference(rows: DataFrame, key: str, layer: DataFrame, columns: dict[str, str], layer_key: str = "fid", small: bool = False) -> DataFrame:
    """``rows`` with columns of the row of ``layer`` that ``key`` names, as
    {column: new name}; null where there is none."""
    far = layer.select(F.col(layer_key).alias("_k"), *[F.col(c).alias(n) for c, n in columns.items()])
    return rows.join(F.broadcast(far) if small else far, rows[key] == F.col("_k"), "left").drop("_k")


def join_tile_biome(tiles: DataFrame, biomes: DataFrame, columns: dict[str, str]) -> DataFrame:
    return join_reference(tiles, "biome", biomes, columns, "name", small=True)


def join_tile_lake(tiles: DataFrame, lakes: DataFrame, columns: dict[str, str]) -> DataFrame:
    return join_reference(tiles, "lake_id", lakes, columns)


def join_culture(tiles: DataFrame, cultures: DataFrame, columns: dict[str, str], key: str = "culture_key") -> DataFrame:
    return join_reference(tiles, key, cultures, columns, key, small=True)


def join_town_tile(towns: DataFrame, tiles: DataFrame, columns: dict[str, str]) -> DataFrame:
    return join_reference(towns, "tile_id", tiles, columns)


def join_tile_town(tiles: DataFrame, towns: DataFrame, columns: dict[str, str]) -> DataFrame:
    return join_reference(tiles, "town_id", towns, columns)


def group_towns_by_nation(tiles: DataFrame) -> DataFrame:
    """(nation_id, n, towns): the towns on each nation's tiles, in order."""
    held = tiles.where("nation_id is not null and town_id is not null")
    return held.groupBy("nation_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("town_id")).alias("towns"))


def subnations_of_nations(tiles: DataFrame) -> DataFrame:
    """(nation_id, n): how many subnations have tiles in a nation."""
    held = tiles.where("nation_id is not null and subnation_id is not null").select("nation_id", "subnation_id").distinct()
    return held.groupBy("nation_id").agg(F.count("*").alias("n"))


def group_kinds(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, kind): size of each group and what land mass it makes: a
    continent above a hundredth of all rows, an island above a thousandth."""
    total = rows.agg(F.count("*").alias("_total"))
    return kind_by_size(rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)), F.col("n"), F.col("_total")).drop("_total")


def kind_by_size(groups: DataFrame, n: Column, total: Column) -> DataFrame:
    return groups.withColumn("kind", F.when(n > F.floor(total / 100), "Continent").when(n > F.floor(total / 1000), "Island").otherwise("Islet"))


def towns_per_water_body(towns: DataFrame, tiles: DataFrame) -> DataFrame:
    """(grouping_id, n): towns by the water body of their harbour."""
    t = join_town_tile(towns.select("tile_id"), tiles, {"harbor_tile_id": "harbor_tile_id"})
    return join_reference(t, "harbor_tile_id", tiles, {"grouping_id": "grouping_id"}).where("grouping_id is not null").groupBy("grouping_id").agg(F.count("*").alias("n"))


def vertex_use_count(vertices: DataFrame) -> DataFrame:
    """(x, y, n): how many tiles meet in each vertex."""
    return vertices.groupBy("x", "y").agg(F.count("*").alias("n"))
