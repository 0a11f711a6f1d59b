"""World construction: points, triangles, tiles."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbisframe.functions.geo import circumcenter, sphere_ring_area
from orbisframe.functions.rand import uniform
from orbisframe.operators.terrain import Limits
from orbisframe.session import cut


#: Sites to a block of the triangulation, and the halo around it, in mean
#: distances of sites along a side: a block holds their square.
BLOCK, HALO = 20, 4


def sphere_area(lim: Limits) -> float:
    """Area of the map on the sphere, in square degrees at the equator."""
    top, low = (math.sin(math.radians(v)) for v in (lim.south + lim.height, lim.south))
    return math.radians(lim.width) * (top - low) * (180 / math.pi) ** 2


def rows_of_points(n_tiles: int, lim: Limits = Limits(), sphere: bool = False) -> tuple[int, float]:
    """Rows of points of a map with about ``n_tiles`` of them, and the distance
    of points in a row at the equator. On a sphere a row's points are as far
    from each other on the ground, so there are fewer towards the poles."""
    step = math.sqrt((sphere_area(lim) if sphere else lim.width * lim.height) / n_tiles)
    return max(1, round(lim.height / step)), step


def gen_points(spark: SparkSession, n_tiles: int, lim: Limits = Limits(), jitter: float = 0.45, stream: str = "", sphere: bool = False) -> DataFrame:
    """(key, x, y): rows of points, about ``n_tiles`` in all, each point moved
    by a keyed draw, and four far corners with negative keys."""
    rows, step = rows_of_points(n_tiles, lim, sphere)
    dy = lim.height / rows
    most = max(1, round(lim.width / step))
    y = lim.south + (F.col("row") + 0.5) * dy
    # halves go up, as in SQL
    cols = F.greatest(F.lit(1), F.floor(lim.width * F.cos(F.radians(y)) / step + 0.5)) if sphere else F.lit(most)
    g = spark.range(rows).withColumnRenamed("id", "row").withColumn("y", y).withColumn("cols", cols.cast("long"))
    g = g.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1))).withColumn("key", F.col("row") * most + F.col("col"))
    move = lambda axis, d: (uniform(f"{stream}point_{axis}", "key") * 2 - 1) * jitter * d
    dx = F.lit(float(lim.width)) / F.col("cols")
    grid = g.select("key", (lim.west + (F.col("col") + 0.5) * dx + move("x", dx)).alias("x"), (F.col("y") + move("y", dy)).alias("y"))
    far = [(-1 - k, lim.west + a * lim.width, lim.south + b * lim.height) for k, (a, b) in enumerate(((-1.0, -1.0), (2.0, -1.0), (-1.0, 2.0), (2.0, 2.0)))]
    return grid.unionByName(spark.createDataFrame(far, "key long, x double, y double"))


def triangulate(points: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Delaunay triangles by inserting points in x order: triangles whose
    circle lies wholly left of the sweep are final, so few are looked at."""
    order = sorted(range(len(points)), key=lambda k: points[k])
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    w = max(max(xs) - min(xs), max(ys) - min(ys), 1.0) * 50
    cx, cy = (max(xs) + min(xs)) / 2, (max(ys) + min(ys)) / 2
    n = len(points)
    every = [*points, (cx - w, cy - w * 0.97), (cx + w * 1.01, cy - w), (cx, cy + w)]

    def circle(t: tuple[int, int, int]) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (qx, qy) = (every[k] for k in t)
        try:
            x, y = circumcenter(ax, ay, bx, by, qx, qy)
        except ZeroDivisionError:
            return 0.0, 0.0, float("inf")
        return x, y, (ax - x) ** 2 + (ay - y) ** 2

    live, done = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}, []
    for k in order:
        px, py = every[k]
        border: dict[tuple[int, int], int] = {}
        for t, (x, y, r2) in list(live.items()):
            if px > x and (px - x) ** 2 > r2:
                done.append(t)
                del live[t]
            elif (px - x) ** 2 + (py - y) ** 2 < r2:
                del live[t]
                for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                    e = (min(a, b), max(a, b))
                    border[e] = border.get(e, 0) + 1
        for (a, b), times in border.items():
            if times == 1:
                live[(a, b, k)] = circle((a, b, k))
    return sorted(tuple(sorted(t)) for t in [*done, *live] if max(t) < n)


def _stars(points: list[tuple[float, float]], keys: list[int], core: set[int], window: tuple[float, float, float, float], extent: tuple[float, float, float, float]) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Triangles around the sites ``core`` that are those of all points, and
    the sites some of whose triangles may not be: their circle reaches parts
    of the extent outside the window. Each triangle is given by its largest
    key."""
    (wx0, wx1, wy0, wy1), (ex0, ex1, ey0, ey1) = window, extent
    beyond = [r for r in ((ex0, wx0, ey0, ey1), (wx1, ex1, ey0, ey1), (ex0, ex1, ey0, wy0), (ex0, ex1, wy1, ey1)) if r[0] < r[1] and r[2] < r[3]]
    sure, doubtful = [], set()
    for t in triangulate(points):
        mine = core.intersection(keys[k] for k in t)
        if not mine:
            continue
        (ax, ay), (bx, by), (cx, cy) = (points[k] for k in t)
        try:
            x, y = circumcenter(ax, ay, bx, by, cx, cy)
            r = math.hypot(ax - x, ay - y) * (1 + 1e-9)
        except ZeroDivisionError:
            x = y = 0.0
            r = math.inf
        if any(math.hypot(max(x0 - x, 0, x - x1), max(y0 - y, 0, y - y1)) <= r for x0, x1, y0, y1 in beyond):
            doubtful |= mine
        sure.append(tuple(sorted(keys[k] for k in t)))
    return [t for t in sure if t[2] in core and t[2] not in doubtful], sorted(doubtful)


def delaunay(points: DataFrame) -> DataFrame:
    """(a, b, c): keys of every triangle, ascending. Points with negative keys
    are far ones around the others; no four points are on one circle.

    The sites are worked on in square blocks, each with the points of a halo
    around it. A site is done if the circles of all its triangles lie inside
    the block and its halo, as far as there are points at all; the others are
    tried again with a halo twice as wide. So a task holds a block, and a
    wider piece of the map only where sites are sparse."""
    n, west, east, south, north = points.where("key >= 0").agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    empty = points.select(F.col("key").alias("a"), F.col("key").alias("b"), F.col("key").alias("c")).limit(0)
    if not n:
        return empty
    far = [(r.key, r.x, r.y) for r in points.where("key < 0").collect()]  # four
    gap = math.sqrt(max((east - west) * (north - south), 1e-12) / n)
    size, halo = BLOCK * gap, HALO * gap
    block = lambda c, low: F.floor((F.col(c) - low) / size).cast("long")
    sites = cut(points.where("key >= 0").select("key", "x", "y", block("x", west).alias("bx"), block("y", south).alias("by")))
    todo, found = sites.select("key", "bx", "by"), empty
    extent = (west, east, south, north)
    while True:
        reach, whole = math.ceil(halo / size), halo > max(east - west, north - south)
        step = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))
        blocks = todo.select("bx", "by").distinct().withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
        near = blocks.select(F.col("bx").alias("hx"), F.col("by").alias("hy"), (F.col("bx") + F.col("i")).alias("bx"), (F.col("by") + F.col("j")).alias("by")).join(sites, ["bx", "by"])
        inside = lambda c, h, low: (F.col(c) >= low + F.col(h) * size - halo) & (F.col(c) <= low + (F.col(h) + 1) * size + halo)  # noqa: B023, E731
        near = near.where(inside("x", "hx", west) & inside("y", "hy", south))
        near = near.join(todo.select(F.col("key"), F.lit(True).alias("core")), "key", "left").withColumn("core", F.coalesce("core", F.lit(False)) & (F.col("bx") == F.col("hx")) & (F.col("by") == F.col("hy")))

        def work(pdf: pd.DataFrame, halo: float = halo) -> pd.DataFrame:
            i, j = int(pdf["hx"].iloc[0]), int(pdf["hy"].iloc[0])
            pdf = pdf.sort_values("key")
            keys = [k for k, _, _ in far] + pdf["key"].tolist()
            at = [(x, y) for _, x, y in far] + list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True))
            window = (west + i * size - halo, west + (i + 1) * size + halo, south + j * size - halo, south + (j + 1) * size + halo)
            done, again = _stars(at, keys, set(pdf["key"][pdf["core"]].tolist()), window, extent)
            return pd.DataFrame([*done, *((k, None, None) for k in again)], columns=["a", "b", "c"]).astype("Int64")

        got = cut(near.select("hx", "hy", "key", "x", "y", "core").groupBy("hx", "hy").applyInPandas(lambda pdf: work(pdf), "a long, b long, c long"))  # noqa: B023
        found = found.unionByName(got.where("c is not null"))
        open_sites = got.where("c is null").select(F.col("a").alias("key"))
        if whole or open_sites.isEmpty():
            return found
        todo, halo = cut(todo.join(open_sites, "key", "left_semi")), 2 * halo


def voronoi(points: DataFrame, triangles: DataFrame, lim: Limits = Limits(), sphere: bool = False) -> DataFrame:
    """(key, site_x, site_y, ring, area): for each site the circumcentres of
    its triangles, clockwise from north, cut to the map; on a sphere their
    centroids, and areas on the ground. Sites are independent: triangles are
    joined to their corners and grouped by site."""
    t = triangles.select(F.struct("a", "b", "c").alias("t"), F.explode(F.array("a", "b", "c")).alias("key"))
    corners = t.join(points, "key").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("key", "x", "y"))).alias("p"))
    p = lambda i, f: F.col("p")[i][f]
    cx, cy = circumcenter(p(0, "x"), p(0, "y"), p(1, "x"), p(1, "y"), p(2, "x"), p(2, "y"))
    if sphere:
        cx, cy = ((p(0, c) + p(1, c) + p(2, c)) / 3 for c in ("x", "y"))
    centers = corners.select(F.explode("p.key").alias("key"), cx.alias("cx"), cy.alias("cy")).where("key >= 0")
    rings = centers.groupBy("key").agg(F.collect_list(F.struct("cx", "cy")).alias("cs")).join(points.select("key", F.col("x").alias("site_x"), F.col("y").alias("site_y")), "key")

    def work(batches):
        for pdf in batches:
            out = []
            for k, cs, x, y in zip(pdf["key"], pdf["cs"], pdf["site_x"], pdf["site_y"], strict=True):
                ring = sorted({(c["cx"], c["cy"]) for c in cs}, key=lambda c: math.atan2(c[0] - x, c[1] - y) % math.tau)  # noqa: B023
                ring = clip_ring(ring, lim)
                if len(ring) > 2:
                    area = sphere_ring_area(ring) if sphere else abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
                    out.append((k, x, y, [{"x": a, "y": b} for a, b in ring], area))
            yield pd.DataFrame(out, columns=["key", "site_x", "site_y", "ring", "area"])

    return rings.select("key", "cs", "site_x", "site_y").mapInPandas(work, "key long, site_x double, site_y double, ring array<struct<x:double,y:double>>, area double")


def clip_ring(ring: list[tuple[float, float]], lim: Limits) -> list[tuple[float, float]]:
    """Convex ring cut to the map's rectangle, side by side."""
    for axis, bound, sign in ((0, lim.west, 1), (0, lim.west + lim.width, -1), (1, lim.south, 1), (1, lim.south + lim.height, -1)):
        out = []
        for k, q in enumerate(ring):
            p = ring[k - 1]
            inside_p, inside_q = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if inside_p != inside_q:
                s = (bound - p[axis]) / (q[axis] - p[axis])
                other = p[1 - axis] + (q[1 - axis] - p[1 - axis]) * s
                out.append((bound, other) if axis == 0 else (other, bound))
            if inside_q:
                out.append(q)
        ring = out
    return ring
