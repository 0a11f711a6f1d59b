"""Borders of regions as geometry: dissolved outlines, coastlines, curved
borders, lakes, rivers, harbours.

Cells share their vertices exactly, so the border of a region is what is left
of its cells' directed sides when those that occur in both directions are taken
out. That is one aggregate over sides; only border sides are linked to rings,
so no task holds a region's area, only its outline.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisframe.functions.curves import flatten
from orbisframe.functions.geo import clip_antimeridian
from orbisframe.operators.terrain import Limits

RINGS = "array<array<struct<x:double,y:double>>>"
Point = tuple[float, float]


def sides(tiles: DataFrame, *columns: str) -> DataFrame:
    """Directed sides (ax, ay, bx, by) of the rings, counterclockwise whatever
    the rings' own direction, with further columns."""
    n = F.size("ring")
    at = lambda i, c: F.get("ring", F.pmod(i, n))[c]
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + at(i, "x") * at(i + 1, "y") - at(i + 1, "x") * at(i, "y"))
    tiles = tiles.withColumn("ring", F.when(twice < 0, F.reverse("ring")).otherwise(F.col("ring")))
    nxt = F.get("ring", F.pmod(F.col("_i") + 1, F.size("ring")))
    return tiles.select(*columns, "ring", F.posexplode("ring").alias("_i", "_a")).select(*columns, F.col("_a.x").alias("ax"), F.col("_a.y").alias("ay"), nxt["x"].alias("bx"), nxt["y"].alias("by"))


def _point(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def border_sides(tiles: DataFrame, theme: str) -> DataFrame:
    """(theme, ax, ay, bx, by): sides between a theme's tiles and others."""
    s = sides(tiles.where(F.col(theme).isNotNull()).select(F.col(theme).alias("theme"), "ring"), "theme")
    a, b = _point("ax", "ay"), _point("bx", "by")
    once = s.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b)).groupBy("theme", "lo", "hi").agg(F.count("*").alias("n"), F.max(F.struct("ax", "ay", "bx", "by")).alias("s"))
    return once.where("n = 1").select("theme", "s.*")


def link_rings(parts: list[tuple[Point, ...]]) -> list[list[Point]]:
    """Closed rings of directed lines, their region to the left, that go on
    where another ends. Where rings touch in a point, the sharpest turn to the
    left is taken, which keeps them apart."""
    at: dict[Point, list] = {}
    for p in sorted(parts):
        at.setdefault(p[0], []).append(p)
    out = []
    for first in sorted(at):
        while at.get(first):
            line = at[first].pop()
            ring = list(line)
            while ring[-1] != first and at.get(ring[-1]):
                here, before = ring[-1], ring[-2]
                back = math.atan2(before[1] - here[1], before[0] - here[0])
                turn = lambda p, back=back, here=here: (back - math.atan2(p[1][1] - here[1], p[1][0] - here[0])) % math.tau or math.tau
                go = min(at[here], key=lambda p, turn=turn: (turn(p), p))
                at[here].remove(go)
                ring.extend(go[1:])
            out.append(ring[:-1] if ring[-1] == ring[0] else ring)
    return out


def signed_area(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def length(ring: list[Point]) -> float:
    return sum(math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def curve_ring(ring: list[Point], scale: float) -> list[Point]:
    """A closed curve through the ring's points; it begins and ends between
    its last point and the first one's successor like any other place."""
    if len(ring) < 3:
        return ring
    around = [ring[-1], *ring, ring[0], ring[1]]
    line = flatten(around, scale)
    begin = line.index(ring[0])
    end = len(line) - 1 - line[::-1].index(ring[0])
    return line[begin:end]


def _as_rows(rings: list[list[Point]]) -> list[list[dict]]:
    return [[{"x": x, "y": y} for x, y in r] for r in rings]


def dissolve(tiles: DataFrame, theme: str, curve: float | None = None) -> DataFrame:
    """(theme, rings, area, border): outline of the union of each theme's
    tiles, holes as rings of their own in the other direction; ``curve`` draws
    them as curves within 1/curve of their lines."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = link_rings([((a, b), (c, d)) for a, b, c, d in zip(pdf["ax"].tolist(), pdf["ay"].tolist(), pdf["bx"].tolist(), pdf["by"].tolist(), strict=True)])
        if curve is not None:
            rings = [curve_ring(r, curve) for r in rings]
        return pd.DataFrame({"theme": [str(pdf["theme"].iloc[0])], "rings": [_as_rows(rings)], "area": [abs(sum(map(signed_area, rings)))], "border": [sum(map(length, rings))]})

    kept = border_sides(tiles, theme).withColumn("theme", F.col("theme").cast("string"))
    # few bytes, much work: by the size alone the planner would give all themes to one task
    dealt = kept.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "theme")
    return dealt.groupBy("theme").applyInPandas(lambda pdf: work(pdf), f"theme string, rings {RINGS}, area double, border double")


def coastline(tiles: DataFrame, ocean: Column, land_mass: str, lim: Limits = Limits(), curve: float | None = 100.0) -> DataFrame:
    """(kind, name, rings, area, border): every land mass, by a column that
    names it, and one ocean, the map's rectangle with the land masses' outer
    rings as holes and the seas inside land as islands of water. Land runs
    clockwise or not as its tiles do; the ocean's area is the map's without
    the land's."""
    land = dissolve(tiles.where(~ocean), land_mass, curve)
    rows = land.select(F.lit("land").alias("kind"), F.col("theme").alias("name"), "rings", "area", "border")
    frame = [{"x": lim.west + a * lim.width, "y": lim.south + b * lim.height} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    box = F.array(F.array(*[F.struct(F.lit(float(p["x"])).alias("x"), F.lit(float(p["y"])).alias("y")) for p in frame]))
    sea = land.agg(F.flatten(F.collect_list("rings")).alias("holes"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.coalesce(F.sum("border"), F.lit(0.0)).alias("border"))
    turned = F.transform("holes", lambda r: F.reverse(r))
    sea = sea.select(F.lit("ocean").alias("kind"), F.lit("ocean").alias("name"), F.concat(box, turned).cast(RINGS).alias("rings"), (F.lit(float(lim.width * lim.height)) - F.col("area")).alias("area"), "border")
    return rows.unionByName(sea)


def shrink_ring(ring: list[Point], by: float) -> list[Point]:
    """Each vertex moved inwards along the bisector of its sides, by at most
    half of the shorter side, so that sides don't pass each other."""
    turn = 1 if signed_area(ring) > 0 else -1
    out = []
    for k, (x, y) in enumerate(ring):
        (px, py), (qx, qy) = ring[k - 1], ring[(k + 1) % len(ring)]
        a, b = math.hypot(x - px, y - py), math.hypot(qx - x, qy - y)
        if not a or not b:
            continue
        nx, ny = -(y - py) / a - (qy - y) / b, (x - px) / a + (qx - x) / b
        size = math.hypot(nx, ny)
        step = min(by, min(a, b) / 2)
        out.append((x + turn * nx / size * step, y + turn * ny / size * step) if size else (x, y))
    return out


def simplify_ring(ring: list[Point], tolerance: float) -> list[Point]:
    """Points that lie within the tolerance of the line between kept ones are
    left out; a smaller tolerance is tried where too few would stay."""
    if len(ring) < 4:
        return ring
    far = max(range(len(ring)), key=lambda k: (math.hypot(ring[k][0] - ring[0][0], ring[k][1] - ring[0][1]), -k))
    while tolerance > 0:
        kept = _simplify(ring[: far + 1], tolerance)[:-1] + _simplify([*ring[far:], ring[0]], tolerance)[:-1]
        if len(kept) > 2:
            return kept
        tolerance -= 0.05
    return ring


def _simplify(line: list[Point], tolerance: float) -> list[Point]:
    keep, work = {0, len(line) - 1}, [(0, len(line) - 1)]
    while work:
        a, b = work.pop()
        (ax, ay), (bx, by) = line[a], line[b]
        size = math.hypot(bx - ax, by - ay)
        away = lambda p: abs((p[0] - ax) * (by - ay) - (p[1] - ay) * (bx - ax)) / size if size else math.hypot(p[0] - ax, p[1] - ay)  # noqa: B023, E731
        top = max(range(a + 1, b), key=lambda k: away(line[k]), default=None)
        if top is not None and away(line[top]) > tolerance:
            keep.add(top)
            work += [(a, top), (top, b)]
    return [line[k] for k in sorted(keep)]


def lake_shapes(tiles: DataFrame, tile_width: float, buffer_scale: float = 2.0, curve: float | None = 100.0, lake: str = "lake_id") -> DataFrame:
    """(fid, rings, area): each lake's tiles in one outline, drawn in by a
    share of a tile's width, simplified and, but for no ``curve``, curved."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for theme, rings in zip(pdf["theme"], pdf["rings"], strict=True):
                drawn = []
                for r in rings:
                    line = [(p["x"], p["y"]) for p in r]
                    kept = simplify_ring(shrink_ring(line, tile_width / 10 * buffer_scale), tile_width / 10)
                    drawn.append(kept if curve is None else curve_ring(kept, curve))
                rows.append((int(theme), _as_rows(drawn), abs(sum(map(signed_area, drawn)))))
            yield pd.DataFrame(rows, columns=["fid", "rings", "area"])

    return dissolve(tiles, lake).select("theme", "rings").mapInPandas(work, f"fid long, rings {RINGS}, area double")


def canonical(line: Column) -> Column:
    """A line in the direction whose points come first: equal for a line and
    its reverse."""
    return F.least(line, F.reverse(line))


def segment_match(a: DataFrame, b: DataFrame, line: str = "line") -> DataFrame:
    """(a_key, b_key, reversed): lines of ``a`` and ``b`` with the same points,
    forward or backward. Both need a ``key``."""
    left = a.select(F.col("key").alias("a_key"), canonical(F.col(line)).alias("c"), F.col(line).alias("a_line"))
    right = b.select(F.col("key").alias("b_key"), canonical(F.col(line)).alias("c"), F.col(line).alias("b_line"))
    return left.join(right, "c").select("a_key", "b_key", (F.col("a_line") != F.col("b_line")).alias("reversed"))


def shared_borders(tiles: DataFrame, theme: str, curve: float | None = 100.0) -> DataFrame:
    """(left, right, line, length): borders between regions, and between a
    region and none (null), cut where three meet. Each is drawn once, whatever
    the number of regions beside it: their outlines stay equal to the last
    bit. ``left`` is the smaller name, and has the border's line on its own
    direction."""
    s = sides(tiles.select(F.col(theme).cast("string").alias("theme"), "ring"), "theme")
    a, b = _point("ax", "ay"), _point("bx", "by")
    s = s.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    # the names beside a side, smallest first, "" for no region; one name alone is inside a region
    named = F.coalesce("theme", F.lit(""))
    pair = s.groupBy("lo", "hi").agg(F.array_sort(F.collect_set(named)).alias("names"), F.count("*").alias("n"), F.min(F.struct(F.col("theme").isNull().alias("z"), F.col("theme"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).alias("d"))
    pair = pair.where("size(names) > 1 or (n = 1 and names[0] != '')")
    rows = pair.select(
        F.col("d.theme").alias("left"), F.when(F.size("names") > 1, F.element_at(F.filter("names", lambda x: x != F.col("d.theme")), 1)).otherwise(F.lit("")).alias("right"),
        F.col("d.ax").alias("ax"), F.col("d.ay").alias("ay"), F.col("d.bx").alias("bx"), F.col("d.by").alias("by"),
    )
    # a vertex where not just two border sides meet is a junction
    ends = rows.select(F.explode(F.array(_point("ax", "ay"), _point("bx", "by"))).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    stop = ends.where("n != 2").select("v.x", "v.y", F.lit(True).alias("j"))
    rows = rows.join(stop.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("j").alias("ja")), ["ax", "ay"], "left").join(stop.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("j").alias("jb")), ["bx", "by"], "left")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        nxt: dict[Point, list[Point]] = {}
        stops: set[Point] = set()
        for ax, ay, bx, by, ja, jb in zip(*(pdf[c].tolist() for c in ("ax", "ay", "bx", "by", "ja", "jb")), strict=True):
            nxt.setdefault((ax, ay), []).append((bx, by))
            stops |= ({(ax, ay)} if ja is True else set()) | ({(bx, by)} if jb is True else set())
        goals = {q for to in nxt.values() for q in to}
        lines = []
        for first in sorted(nxt, key=lambda p: (p not in stops and p in goals, p)):
            while nxt.get(first):
                line = [first, nxt[first].pop(0)]
                while line[-1] not in stops and line[-1] != first and nxt.get(line[-1]):
                    line.append(nxt[line[-1]].pop(0))
                lines.append(line)
        if curve is not None:
            lines = [[*curve_ring(x[:-1], curve), x[0]] if x[0] == x[-1] and len(x) > 3 else flatten(x, curve) for x in lines]
        size = [sum(math.hypot(q[0] - p[0], q[1] - p[1]) for p, q in zip(x, x[1:], strict=False)) for x in lines]
        return pd.DataFrame({"left": [pdf["left"].iloc[0]] * len(lines), "right": [pdf["right"].iloc[0] or None] * len(lines), "line": [[{"x": x, "y": y} for x, y in line] for line in lines], "length": size})

    return rows.groupBy("left", "right").applyInPandas(lambda pdf: work(pdf), "left string, right string, line array<struct<x:double,y:double>>, length double")


def curvify(tiles: DataFrame, theme: str, curve: float = 100.0) -> DataFrame:
    """(theme, rings, area): outlines put together again from the borders,
    each curved once, so that neighbours still meet without gaps."""
    lines = shared_borders(tiles, theme, curve)
    both = lines.select(F.col("left").alias("theme"), "line").unionByName(lines.where("right is not null").select(F.col("right").alias("theme"), F.reverse("line").alias("line")))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = link_rings([tuple((p["x"], p["y"]) for p in line) for line in pdf["line"]])
        return pd.DataFrame({"theme": [pdf["theme"].iloc[0]], "rings": [_as_rows(rings)], "area": [abs(sum(map(signed_area, rings)))]})

    return both.groupBy("theme").applyInPandas(lambda pdf: work(pdf), f"theme string, rings {RINGS}, area double")


def harbor_points(tiles: DataFrame, harbors: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """(fid, x, y): middle of the border between a tile and its harbour tile.
    ``harbors`` has fid, harbor and kind; across the map it is the middle of
    the tile's side on the map's own border. Anything but two common vertices
    is an error when the row is read."""
    own = tiles.select("fid", "ring")
    other = tiles.select(F.col("fid").alias("harbor"), F.col("ring").alias("_r"))
    j = harbors.select("fid", "harbor", "kind").join(own, "fid").join(other, "harbor", "left")
    outer = F.filter("ring", lambda v: (v["x"] == lim.west) | (v["x"] == lim.west + lim.width))
    common = F.when(F.col("kind") == "Tile", F.array_intersect("ring", "_r")).otherwise(F.array_distinct(outer))
    j = j.withColumn("_c", common)
    mid = lambda axis: F.when(F.size("_c") == 2, (F.get("_c", F.lit(0))[axis] + F.get("_c", F.lit(1))[axis]) / 2).otherwise(F.raise_error(F.concat(F.lit("no single side to a harbour at tile "), F.col("fid").cast("string"))).cast("double"))
    return j.select("fid", mid("x").alias("x"), mid("y").alias("y"))


def points_within(points: DataFrame, others: DataFrame, distance: float) -> DataFrame:
    """The points (key, x, y) with one of the others (x, y) nearer than
    ``distance``. Points meet by cells of that width and their neighbours."""
    cell = lambda c: F.floor(F.col(c) / distance).cast("long")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    o = others.select(F.col("x").alias("_x"), F.col("y").alias("_y"), step.alias("_s"))
    o = o.select("_x", "_y", (F.floor(F.col("_x") / distance).cast("long") + F.col("_s.a")).alias("_cx"), (F.floor(F.col("_y") / distance).cast("long") + F.col("_s.b")).alias("_cy"))
    p = points.withColumn("_px", cell("x")).withColumn("_py", cell("y"))
    near = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")) < distance * distance
    return p.join(o, (p["_px"] == o["_cx"]) & (p["_py"] == o["_cy"]) & near, "left_semi").drop("_px", "_py")


def river_curves(segments: DataFrame, tiles: DataFrame, curve: float = 100.0, lim: Limits = Limits()) -> DataFrame:
    """(from, to, lines): each river segment as a curve that goes on smoothly
    from the segment before it (the one with the largest flow) and into the one
    after it, cut at the map's east and west. ``segments``: from, to, to_flow,
    kind (Tile or CrossMap)."""
    site = lambda key, a, b: tiles.select(F.col("fid").alias(key), F.col("site_x").alias(a), F.col("site_y").alias(b))
    before = segments.groupBy(F.col("to").alias("from")).agg(F.max(F.struct("to_flow", F.col("from").alias("f"))).alias("m")).select("from", F.col("m.f").alias("prev"))
    after = segments.where("to is not null").groupBy(F.col("from").alias("to")).agg(F.max(F.struct("to_flow", F.col("to").alias("t"))).alias("m")).select("to", F.col("m.t").alias("next"))
    j = segments.where("to is not null").select("from", "to").distinct().join(before, "from", "left").join(after, "to", "left")
    j = j.join(site("from", "x1", "y1"), "from").join(site("to", "x2", "y2"), "to").join(site("prev", "x0", "y0"), "prev", "left").join(site("next", "x3", "y3"), "next", "left")

    def near(x: float, to: float) -> float:
        return x - lim.width if x - to > lim.width / 2 else x + lim.width if to - x > lim.width / 2 else x

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f, t, *c in pdf[["from", "to", "x1", "y1", "x2", "y2", "x0", "y0", "x3", "y3"]].itertuples(index=False):
                a, b = (c[0], c[1]), (near(c[2], c[0]), c[3])
                line = [a, b]
                if not math.isnan(c[4]):
                    line.insert(0, (near(c[4], a[0]), c[5]))
                if not math.isnan(c[6]):
                    line.append((near(c[6], b[0]), c[7]))
                drawn = flatten(line, curve)
                drawn = drawn[drawn.index(a) : len(drawn) - drawn[::-1].index(b)]
                out.append((f, t, _as_rows(clip_antimeridian(drawn, lim.west, lim.width))))
            yield pd.DataFrame(out, columns=["from", "to", "lines"])

    return j.select("from", "to", "x1", "y1", "x2", "y2", "x0", "y0", "x3", "y3").mapInPandas(work, f"from long, to long, lines {RINGS}")
