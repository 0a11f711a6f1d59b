"""Biomes: default table, matrix, and their application to tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default biomes as name, habitability, criteria kind, threshold,
# movement cost, nomads, hunters, colour.
DEFAULTS = (
    ("Ocean", 0, "Ocean", None, 10, False, False, "#1F78B4"),
    ("Hot Desert", 4, "Matrix", None, 200, True, False, "#FBE79F"),
    ("Cold Desert", 10, "Matrix", None, 150, True, False, "#B5B887"),
    ("Savanna", 22, "Matrix", None, 60, False, True, "#D2D082"),
    ("Grassland", 30, "Matrix", None, 50, True, False, "#C8D68F"),
    ("Tropical Seasonal Forest", 50, "Matrix", None, 70, False, False, "#B6D95D"),
    ("Temperate Deciduous Forest", 100, "Matrix", None, 70, False, True, "#29BC56"),
    ("Tropical Rainforest", 80, "Matrix", None, 80, False, False, "#7DCB35"),
    ("Temperate Rainforest", 90, "Matrix", None, 90, False, True, "#409C43"),
    ("Taiga", 12, "Matrix", None, 200, False, True, "#4B6B32"),
    ("Tundra", 4, "Matrix", None, 1000, False, True, "#96784B"),
    ("Glacier", 0, "Glacier", -5.0, 5000, False, False, "#D5E7EB"),
    ("Wetland", 12, "Wetland", 400.0, 150, False, True, "#0B9131"),
)
# Biome by moisture band (rows, driest first) and temperature band (26, hot to cold).
MATRIX = (
    (
        "Hot Desert", "Hot Desert", "Hot Desert", "Hot Desert",
        "Hot Desert", "Hot Desert", "Hot Desert", "Hot Desert",
        "Cold Desert", "Cold Desert", "Cold Desert", "Cold Desert",
        "Cold Desert", "Cold Desert", "Cold Desert", "Cold Desert",
        "Cold Desert", "Cold Desert", "Cold Desert", "Cold Desert",
        "Cold Desert", "Cold Desert", "Cold Desert", "Cold Desert",
        "Cold Desert", "Tundra",
    ),
    (
        "Savanna", "Savanna", "Savanna", "Grassland",
        "Grassland", "Grassland", "Grassland", "Grassland",
        "Grassland", "Grassland", "Grassland", "Grassland",
        "Grassland", "Grassland", "Grassland", "Grassland",
        "Grassland", "Grassland", "Grassland", "Taiga",
        "Taiga", "Taiga", "Taiga", "Tundra",
        "Tundra", "Tundra",
    ),
    (
        "Tropical Seasonal Forest", "Temperate Deciduous Forest", "Temperate Deciduous Forest", "Temperate Deciduous Forest",
        "Temperate Deciduous Forest", "Temperate Deciduous Forest", "Temperate Deciduous Forest", "Temperate Deciduous Forest",
        "Temperate Deciduous Forest", "Temperate Deciduous Forest", "Temperate Deciduous Forest", "Temperate Deciduous Forest",
        "Temperate Deciduous Forest", "Temperate Deciduous Forest", "Temperate Deciduous Forest", "Temperate Deciduous Forest",
        "Temperate Deciduous Forest", "Temperate Deciduous Forest", "Taiga", "Taiga",
        "Taiga", "Taiga", "Taiga", "Tundra",
        "Tundra", "Tundra",
    ),
    (
        "Tropical Seasonal Forest", "Temperate Deciduous Forest", "Temperate Deciduous Forest", "Temperate Deciduous Forest",
        "Temperate Deciduous Forest", "Temperate Deciduous Forest", "Temperate Deciduous Forest", "Temperate Rainforest",
        "Temperate Rainforest", "Temperate Rainforest", "Temperate Rainforest", "Temperate Rainforest",
        "Temperate Rainforest", "Temperate Rainforest", "Temperate Rainforest", "Temperate Rainforest",
        "Temperate Rainforest", "Taiga", "Taiga", "Taiga",
        "Taiga", "Taiga", "Taiga", "Tundra",
        "Tundra", "Tundra",
    ),
    (
        "Tropical Rainforest", "Temperate Rainforest", "Temperate Rainforest", "Temperate Rainforest",
        "Temperate Rainforest", "Temperate Rainforest", "Temperate Rainforest", "Temperate Rainforest",
        "Temperate Rainforest", "Temperate Rainforest", "Temperate Rainforest", "Temperate Rainforest",
        "Temperate Rainforest", "Temperate Rainforest", "Temperate Rainforest", "Temperate Rainforest",
        "Temperate Rainforest", "Taiga", "Taiga", "Taiga",
        "Taiga", "Taiga", "Taiga", "Taiga",
        "Tundra", "Tundra",
    ),
)
SCHEMA = "name string, habitability int, kind string, threshold double, movement_cost int, supports_nomadic boolean, supports_hunting boolean, color string"


def defaults(spark: SparkSession, glacier: float | None = None, wetland: float | None = None) -> DataFrame:
    """The default biomes, with cells array<struct<moisture,temperature>>."""
    over = {"Glacier": glacier, "Wetland": wetland}
    cells: dict[str, list] = {}
    for moisture, row in enumerate(MATRIX):
        for temperature, name in enumerate(row):
            cells.setdefault(name, []).append((moisture, temperature))
    rows = [(*r[:3], over.get(r[2]) if over.get(r[2]) is not None else r[3], *r[4:], cells.get(r[0], [])) for r in DEFAULTS]
    return spark.createDataFrame(rows, SCHEMA + ", cells array<struct<moisture:int,temperature:int>>")


def matrix(biomes: DataFrame) -> DataFrame:
    """(moisture, temperature, biome); a slot that is missing or taken twice
    is an error when the result is read."""
    cells = biomes.where("kind = 'Matrix'").select("name", F.explode("cells").alias("c")).select("c.moisture", "c.temperature", "name")
    slots = biomes.sparkSession.range(5 * 26).select((F.col("id") / 26).cast("int").alias("moisture"), (F.col("id") % 26).cast("int").alias("temperature"))
    got = slots.join(cells.groupBy("moisture", "temperature").agg(F.count("*").alias("n"), F.min("name").alias("biome")), ["moisture", "temperature"], "left")
    bad = F.concat(F.lit("biome slot "), F.col("moisture").cast("string"), F.lit(","), F.col("temperature").cast("string"), F.lit(" is missing or taken twice"))
    return got.select("moisture", "temperature", F.when(F.coalesce("n", F.lit(0)) == 1, F.col("biome")).otherwise(F.raise_error(bad)).alias("biome"))


def moisture_band(p: Column) -> Column:
    level = F.floor(p / 20)
    return F.when(p < 1, 0).when(p < 2, 1).when(level <= 2, 2).when(level <= 3, 3).otherwise(4).cast("int")


def temperature_band(t: Column) -> Column:
    return F.least(F.lit(25), F.floor(F.greatest(F.lit(0.0), 20 - t))).cast("int")


def apply(tiles: DataFrame, lakes: DataFrame, biomes: DataFrame, glacier: float = -5.0, wetland: float = 400.0, grouping: str = "grouping") -> DataFrame:
    """Tiles with their biome: a broadcast join with the 130-row matrix and
    one with the lakes' types; nothing else moves."""
    table = F.broadcast(matrix(biomes).select(F.col("moisture").alias("_m"), F.col("temperature").alias("_t"), F.col("biome").alias("_b")))
    marsh = lakes.select(F.col("fid").alias("_lake"), F.col("type_").alias("_type"))
    out = tiles.join(marsh, tiles["lake_id"] == F.col("_lake"), "left").withColumn("_mb", moisture_band(F.col("precipitation"))).withColumn("_tb", temperature_band(F.col("temperature")))
    out = out.join(table, (F.col("_mb") == F.col("_m")) & (F.col("_tb") == F.col("_t")), "left")
    b = F.when(F.col(grouping) == "Ocean", "Ocean").when(F.col("temperature") < glacier, "Glacier").when((F.col("water_flow") > wetland) | F.coalesce(F.col("_type") == "Marsh", F.lit(False)), "Wetland").otherwise(F.col("_b"))
    return out.withColumn("biome", b).drop("_lake", "_type", "_mb", "_tb", "_m", "_t", "_b")
