"""Queries of seeded draws and of overlays of regions, with the SQL that gives
the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbisframe.functions.rand import stream, uniform
from orbisframe.operators import construct, layers, outlines, overlay, terrain
from orbisframe.operators.terrain import Limits
from orbisframe.plans.registry import _CL, R6, G, query, rings

# draws


@query(f"select fid, round(elevation,6) elevation from (select fid, {_CL.format('e1+(-450e0+U(seed=7/terrain/1/ru,fid)*1350e0)')} elevation from (select fid, {_CL.format('elevation+(-450e0+U(seed=7/terrain/0/ru,fid)*1350e0)')} e1 from tiles))")
def terrain_random_tasks(w):
    """The same task twice in a seeded recipe: each draws from its own stream."""
    task = {"task": "RandomUniform", "height_delta": "-5..=10"}
    out = terrain.recipe(w.tiles.withColumnRenamed(G, "grouping"), w.edges, [task, task], stream=stream(7, "terrain"))
    return out.select("fid", R6(F.col("elevation")).alias("elevation"))


# overlays


def _regions(w, theme):
    return outlines.dissolve(rings(w), theme).select(F.col("theme").alias("key"), "rings")


@query("select culture_key::varchar a, nation_id::varchar b, round(sum(area),4) area from tiles where culture_key is not null and nation_id is not null group by 1, 2")
def overlay_intersection(w):
    both = overlay.intersection(_regions(w, "culture_key"), _regions(w, "nation_id"))
    return both.groupBy("a", "b").agg(F.round(F.sum("area"), 4).alias("area"))


@query("select culture_key::varchar a, round(sum(area),4) area from tiles where culture_key is not null and nation_id is null group by 1")
def overlay_difference(w):
    left = overlay.difference(_regions(w, "culture_key"), _regions(w, "nation_id"))
    return left.groupBy("a").agg(F.round(F.sum("area"), 4).alias("area"))


_WINDOW = Limits(west=-101.3, south=-47.9, width=180.7, height=88.4)


@query("""select k a, round(sum((least(x1,79.4e0)-greatest(x0,-101.3e0))*(least(y1,40.5e0)-greatest(y0,-47.9e0))),3) area
  from (select culture_key::varchar k, -180e0+(col*360e0)/w x0, -180e0+((col+1)*360e0)/w x1, -90e0+(rw*180e0)/w y0, -90e0+((rw+1)*180e0)/w y1 from tiles where culture_key is not null)
  where x1>-101.3e0 and x0<79.4e0 and y1>-47.9e0 and y0<40.5e0 group by 1""")  # fmt: skip
def overlay_clip(w):
    """Regions cut to a window whose sides run through tiles."""
    out = overlay.clip(_regions(w, "culture_key"), _WINDOW)
    return out.groupBy("a").agg(F.round(F.sum("area"), 3).alias("area"))


@query("select culture_key::varchar a, round(sum(area),4) area from tiles where culture_key is not null group by 1")
def overlay_valid(w):
    """Every tile's ring, in one region each: overlapping sides vanish."""
    t = rings(w).where("culture_key is not null").select(F.col("culture_key").alias("key"), F.array("ring").alias("rings"))
    return overlay.make_valid(t).groupBy("a").agg(F.round(F.sum("area"), 4).alias("area"))


@query("select 'land' kind, grouping_ as name, round(sum(area),4) area from tiles where grouping_<>'Ocean' group by 2 union all select 'ocean', 'ocean', round(64800e0-coalesce(sum(area) filter (grouping_<>'Ocean'),0e0),4) from tiles")
def coastline_rings(w):
    """Land and the ocean as its difference with the map, straight lines."""
    out = overlay.coast(rings(w), F.col(G) == "Ocean", G, Limits(), None)
    return out.groupBy("kind", "name").agg(F.round(F.sum("area"), 4).alias("area"))


# tessellation


def _sites(w):
    """A scattered point for each customer, and the four far ones."""
    c = w.spark.read.parquet(f"{w.sf_dir}/customer.parquet")
    at = c.select(F.col("c_custkey").alias("key"), (-180.0 + uniform("sx", "c_custkey") * 360.0).alias("x"), (-90.0 + uniform("sy", "c_custkey") * 180.0).alias("y"))
    return at.unionByName(construct.gen_points(w.spark, 1).where("key < 0"))


@query("select count(*) sites, 2*(count(*)+4)-2-4 triangles, 3e0*360e0*3e0*180e0 area from customer")
def delaunay_sites(w):
    """Triangles fill the hull of all points without gaps: their number and
    area follow from the number of sites. A test compares them one by one."""
    points = _sites(w)
    t = construct.delaunay(points).withColumn("t", F.monotonically_increasing_id())
    p = lambda k: points.select(F.col("key").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    t = t.join(p("a"), "a").join(p("b"), "b").join(p("c"), "c")
    twice = F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay")))
    sites = points.where("key >= 0").agg(F.count("*").alias("sites"))
    return t.agg(F.count("*").alias("triangles"), F.round(F.sum(twice) / 2, 3).alias("area")).crossJoin(sites)


@query("select rw as row, greatest(1,floor(360e0*cos(radians(-90e0+(rw+0.5e0)*(180e0/n)))/step+0.5e0))::bigint points from (select step, n, unnest(range(n)) rw from (select step, greatest(1,round(180e0/step))::bigint n from (select sqrt(129600e0/pi()/count(*)) step from customer)))")
def sphere_points(w):
    """As many points as customers, by the row of the globe they are in."""
    n = w.spark.read.parquet(f"{w.sf_dir}/customer.parquet").count()
    rows, _ = construct.rows_of_points(n, sphere=True)
    most = max(1, round(360 / construct.rows_of_points(n, sphere=True)[1]))
    return construct.gen_points(w.spark, n, sphere=True).where("key >= 0").groupBy(F.expr(f"key div {most}").alias("row")).agg(F.count("*").alias("points"))


@query("select count(*) sites, round(4e0*pi()*6378137e0*6378137e0/12392029000e0,3) area from customer")
def sphere_tiles(w):
    """Cells of the customers' points on the sphere cover it."""
    points = _sites(w)
    cells = construct.voronoi(points, construct.delaunay(points), sphere=True)
    return cells.agg(F.count("*").alias("sites"), F.round(F.sum("area"), 3).alias("area"))


# borders


@query("""select lake_id fid, round((360e0/w-sqrt(2)*s)*(180e0/w-sqrt(2)*s),6) area from (select lake_id, w, 0.2e0*sqrt(64800e0/(w*w)) s from tiles where lake_id is not null)""")
def lake_shape_area(w):
    """Lakes of one tile, drawn in along the bisectors of their corners."""
    width = layers.average_tile_area(w.tiles).first().avg_area ** 0.5
    return outlines.lake_shapes(rings(w), width, curve=None).select("fid", R6(F.col("area")).alias("area"))


@query("""select a.fid a_fid, b.fid b_fid from tiles a join tiles b on mod(a.col+a.rw,2)=0 and ((abs(a.col-b.col)=1 and a.rw=b.rw) or (a.col=b.col and abs(a.rw-b.rw)=1))""")
def segment_match_sides(w):
    """The sides of every other tile are those of its four neighbours, drawn
    in the other direction."""
    t = rings(w)
    s = outlines.sides(t.select(((F.col("col") + F.col("rw")) % 2).alias("odd"), "fid", "ring"), "odd", "fid")
    line = F.array(*[F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in ("a", "b")])
    s = s.select("odd", F.col("fid").alias("key"), line.alias("line"))
    return outlines.segment_match(s.where("odd = 0"), s.where("odd = 1")).where("reversed").select(F.col("a_key").alias("a_fid"), F.col("b_key").alias("b_fid"))
