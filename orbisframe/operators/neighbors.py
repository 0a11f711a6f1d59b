"""The neighbour table of a tessellation: who shares a vertex, who lies across
the antimeridian, and where the map ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisframe.functions import edges as E
from orbisframe.functions import geo
from orbisframe.operators.graph import antimeridian_neighbors, vertex_neighbors
from orbisframe.operators.terrain import Limits


def boxes(tiles: DataFrame) -> DataFrame:
    """``tiles`` with the bounds of their rings."""
    out = tiles
    for name, axis, pick in (("x_min", "x", F.array_min), ("x_max", "x", F.array_max), ("y_min", "y", F.array_min), ("y_max", "y", F.array_max)):
        out = out.withColumn(name, pick(F.col(f"ring.{axis}")))
    return out


def with_edge(tiles: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """``tiles`` with the edge of the map that their ring touches."""
    b = boxes(tiles)
    edge = E.box_on_edge(F.col("x_min"), F.col("y_min"), F.col("x_max"), F.col("y_max"), lim.west, lim.south, lim.width, lim.height)
    return b.withColumn("edge", edge).drop("x_min", "x_max", "y_min", "y_max")


def calc_neighbors(tiles: DataFrame, lim: Limits = Limits(), sphere: bool = False) -> DataFrame:
    """(src, dst, kind, edge, bearing) from tiles with fid, site_x, site_y and
    ring. Tiles that share a vertex exactly are neighbours. On a map that goes
    all around, tiles of the two outer sides whose latitudes overlap are
    neighbours across it. Where neither holds, and no pole is reached, a tile
    on the border has the world's end (dst null) as a neighbour, in the
    direction of that edge. Joins are on vertices and latitude cells only."""
    marked = with_edge(tiles.select("fid", "site_x", "site_y", "ring"), lim)
    wraps = lim.width == 360
    vertices = marked.select("fid", F.explode("ring").alias("v")).select("fid", "v.x", "v.y")
    pairs = vertex_neighbors(vertices).select("src", "dst", F.lit("Tile").alias("kind"))
    if wraps:
        border = boxes(marked.where("edge is not null")).select("fid", "x_min", "x_max", "y_min", "y_max")
        pairs = pairs.unionByName(antimeridian_neighbors(border, lim.west, lim.west + lim.width).select("src", "dst", F.lit("CrossMap").alias("kind")))
    here = marked.select(F.col("fid").alias("src"), F.col("site_x").alias("x1"), F.col("site_y").alias("y1"), F.col("edge").alias("own"))
    there = tiles.select(F.col("fid").alias("dst"), F.col("site_x").alias("x2"), F.col("site_y").alias("y2"))
    x2 = F.when(F.col("kind") == "CrossMap", geo.across_antimeridian(F.col("x2"), F.col("x1"))).otherwise(F.col("x2"))
    inside = pairs.join(here, "src").join(there, "dst").select(
        "src", "dst", "kind", F.when(F.col("kind") == "CrossMap", F.col("own")).alias("edge"), geo.bearing(F.col("x1"), F.col("y1"), x2, F.col("y2"), sphere).alias("bearing")
    )
    end = E.open_edge(F.col("edge"), wraps, lim.south + lim.height >= 90, lim.south <= -90)
    off = marked.select(F.col("fid").alias("src"), end.alias("edge")).where("edge is not null")
    off = off.select("src", F.lit(None).cast("long").alias("dst"), F.lit("OffMap").alias("kind"), "edge", E.direction(F.col("edge")).cast("double").alias("bearing"))
    return inside.unionByName(off)
