"""Overlay of polygon layers: intersection, difference, clipping, making valid.

A layer has a key and rings (see ``outlines``); what a ring winds around is
inside, in either direction, so overlapping and self-crossing rings are read as
the union of their parts. The work is done in cells of a square grid:

1. Coordinates are put on a lattice of 1e-9, and sides are cut at the grid's
   lines, which lie half a step beside the lattice, so no vertex and no side
   lies on one. Each piece belongs to one cell.
2. Pieces that pass a cell's lower line change the winding number of every
   cell corner to their right, so sums along a row of the grid give it there,
   for those regions too that cover a cell without a side in it.
3. Inside a cell the pieces are cut where they meet, equal ones are put
   together, and each has the winding numbers of all regions on both sides.
   It bounds a result if that is on one side only.
4. The result's pieces are linked to rings in the cell, what stays open in
   blocks of cells, and so on, so only rings that span a large block meet
   there, and each ring is a row.

Defined results: rows with a null key or null rings are left out, rings of
fewer than three points have no inside, repeated rows are one region, an empty
layer covers nothing. Vertices lie within 1e-9 of their exact places.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbisframe.operators.outlines import Point, curvify, dissolve, link_rings, signed_area
from orbisframe.operators.terrain import Limits
from orbisframe.session import cut

#: Decimals of the lattice, and how near a vertex counts as on a side.
DECIMALS, NEAR = 9, 2e-9
HALF = 0.5 * 10.0**-DECIMALS
_BEGIN = 0.3819660112501051
#: Sides to a cell, about, and cells to a block's side when rings are linked.
PER_CELL, BLOCK = 24, 8
#: Sides to a task, about, and cells to a side of the square that one call works on.
PER_TASK, SQUARE = 8000, 4

_LINE = "array<struct<x:double,y:double>>"
_PIECE = "side int, key string, ax double, ay double, bx double, by double, cx long, cy long"


def layer_sides(layer: DataFrame, key: str, side: int) -> DataFrame:
    """(side, key, ax, ay, bx, by) on the lattice, of layer number ``side``."""
    rings = layer.where(F.col(key).isNotNull()).select(F.lit(side).alias("side"), F.col(key).cast("string").alias("key"), F.explode("rings").alias("ring"))
    rings = rings.where(F.size("ring") > 2).distinct()
    snap = lambda c: F.round(c, DECIMALS) + 0.0
    nxt = F.get("ring", F.pmod(F.col("i") + 1, F.size("ring")))
    s = rings.select("side", "key", "ring", F.posexplode("ring").alias("i", "a"))
    s = s.select("side", "key", snap("a.x").alias("ax"), snap("a.y").alias("ay"), snap(nxt["x"]).alias("bx"), snap(nxt["y"]).alias("by"))
    return s.where("ax != bx or ay != by")


def grid_line(k: int, cell: float) -> float:
    """Place of the grid's line ``k``: half a step beside the lattice, and the
    grid begins at an odd place, so round coordinates aren't near a line."""
    return round((k + _BEGIN) * cell, DECIMALS) + HALF


def cell_of(v: float, cell: float) -> int:
    k = math.floor(v / cell - _BEGIN)
    while v < grid_line(k, cell):
        k -= 1
    while v > grid_line(k + 1, cell):
        k += 1
    return k


def cut_side(a: Point, b: Point, cell: float) -> list[tuple[Point, Point, int, int]]:
    """Pieces of a side with their cells; a side and its reverse are cut at
    the same points."""
    if b < a:
        return [(q, p, i, j) for p, q, i, j in reversed(cut_side(b, a, cell))]
    stops = []
    for axis in (0, 1):
        lo, hi = sorted((cell_of(a[axis], cell), cell_of(b[axis], cell)))
        for k in range(lo + 1, hi + 1):
            at = grid_line(k, cell)
            t = (at - a[axis]) / (b[axis] - a[axis])
            other = round(a[1 - axis] + t * (b[1 - axis] - a[1 - axis]), DECIMALS)
            stops.append((t, (at, other) if axis == 0 else (other, at)))
    points = [a, *(p for _, p in sorted(stops)), b]
    out = []
    for p, q in zip(points, points[1:]):  # noqa: B905
        if p != q:
            out.append((p, q, cell_of((p[0] + q[0]) / 2, cell), cell_of((p[1] + q[1]) / 2, cell)))
    return out


def _pieces(sides: DataFrame, cell: float) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for side, key, ax, ay, bx, by in zip(*(pdf[c].tolist() for c in ("side", "key", "ax", "ay", "bx", "by")), strict=True):
                rows += [(side, key, *p, *q, i, j) for p, q, i, j in cut_side((ax, ay), (bx, by), cell)]
            yield pd.DataFrame(rows, columns=["side", "key", "ax", "ay", "bx", "by", "cx", "cy"])

    return sides.mapInPandas(work, _PIECE)


def _corners(pieces: DataFrame, cell: float) -> DataFrame:
    """(side, key, cx, cy, winding): regions that wind around the lower left
    corner of a cell, for the cells with pieces."""
    line = F.udf(lambda k: grid_line(k, cell), "double")
    rows = pieces.select("cy").distinct().withColumn("low", line("cy"))
    sign = F.when(F.col("ay") == F.col("low"), -1).when(F.col("by") == F.col("low"), 1)
    passing = pieces.join(F.broadcast(rows), "cy").withColumn("step", sign).where("step is not null")
    events = passing.groupBy("side", "key", "cy", "cx").agg(F.sum("step").alias("step"))
    along = Window.partitionBy("side", "key", "cy").orderBy("cx")
    runs = events.withColumn("winding", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("cx").over(along))
    runs = runs.where("winding != 0 and next is not null")
    covered = runs.select("side", "key", "cy", "winding", F.explode(F.sequence(F.col("cx") + 1, F.col("next"))).alias("cx"))
    return covered.join(pieces.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")


def _split(a: np.ndarray, b: np.ndarray) -> list[tuple[int, Point, Point]]:
    """Segments cut at their crossings and at vertices that lie on them."""
    n, d = len(a), b - a
    stops: list[list[tuple[float, Point]]] = [[] for _ in range(n)]
    lo, hi = np.minimum(a, b) - NEAR, np.maximum(a, b) + NEAR
    size2 = (d * d).sum(axis=1)
    meet = ((lo[:, None] <= hi[None]) & (lo[None] <= hi[:, None])).all(axis=2)
    i, j = np.nonzero(meet & ~np.eye(n, dtype=bool))
    # vertices of j on the segment i
    for end in (a, b):
        v = end[j] - a[i]
        t = (v * d[i]).sum(axis=1) / size2[i]
        away = np.abs(d[i, 0] * v[:, 1] - d[i, 1] * v[:, 0]) / np.sqrt(size2[i])
        edge = NEAR / np.sqrt(size2[i])
        for k in np.flatnonzero((away <= NEAR) & (t > edge) & (t < 1 - edge)):
            stops[i[k]].append((float(t[k]), (float(end[j[k], 0]), float(end[j[k], 1]))))
    half = i < j
    i, j = i[half], j[half]
    den = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    v = a[j] - a[i]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (v[:, 0] * d[j, 1] - v[:, 1] * d[j, 0]) / den, (v[:, 0] * d[i, 1] - v[:, 1] * d[i, 0]) / den
        ei, ej = NEAR / np.sqrt(size2[i]), NEAR / np.sqrt(size2[j])
        cross = np.flatnonzero((t > ei) & (t < 1 - ei) & (u > ej) & (u < 1 - ej))
    for k in cross:
        p = (round(float(a[i[k], 0] + t[k] * d[i[k], 0]), DECIMALS), round(float(a[i[k], 1] + t[k] * d[i[k], 1]), DECIMALS))
        stops[i[k]].append((float(t[k]), p))
        stops[j[k]].append((float(u[k]), p))
    out = []
    for k in range(n):
        points = [tuple(a[k].tolist()), *(p for _, p in sorted(stops[k])), tuple(b[k].tolist())]
        out += [(k, p, q) for p, q in zip(points, points[1:]) if p != q]  # noqa: B905
    return out


def windings(keys: list, a: np.ndarray, b: np.ndarray, corner: dict, left_line: float) -> tuple[list[tuple[Point, Point]], list, np.ndarray, np.ndarray]:
    """Pieces of a cell's arrangement from their smaller to their larger end,
    the regions, and each one's winding number on the left and right of each
    piece. ``corner``: winding numbers at the lower left corner."""
    names = sorted({*keys, *corner})
    number = {k: i for i, k in enumerate(names)}
    net: dict[tuple[Point, Point], np.ndarray] = defaultdict(lambda: np.zeros(len(names), np.int64))
    for k, p, q in _split(a, b):
        if p < q:
            net[p, q][number[keys[k]]] += 1
        else:
            net[q, p][number[keys[k]]] -= 1
    pieces = sorted(p for p, n in net.items() if n.any())
    if not pieces:
        return [], names, np.zeros((0, len(names)), np.int64), np.zeros((0, len(names)), np.int64)
    n = np.array([net[p] for p in pieces])
    lo, hi = np.array([p for p, _ in pieces]), np.array([q for _, q in pieces])
    up = np.sign(hi[:, 1] - lo[:, 1]).astype(np.int64)
    mid = (lo + hi) / 2
    low, high = np.minimum(lo[:, 1], hi[:, 1]), np.maximum(lo[:, 1], hi[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = lo[:, 0] + (mid[:, 1][:, None] - lo[:, 1]) * ((hi[:, 0] - lo[:, 0]) / (hi[:, 1] - lo[:, 1]))
    before = (low <= mid[:, 1][:, None]) & (mid[:, 1][:, None] < high) & (at < mid[:, 0][:, None])
    np.fill_diagonal(before, False)
    entering = (lo[:, 0] == left_line) & (lo[:, 1] <= mid[:, 1][:, None])
    base = np.array([corner.get(k, 0) for k in names])
    west = base + entering.astype(np.int64) @ n - before.astype(np.int64) @ (up[:, None] * n)
    # the west is on the left of what goes up, and of what goes east the north is
    left = np.where((up >= 0)[:, None], west, west + n)
    return pieces, names, left, left - n


def chains(parts: list[tuple[Point, ...]]) -> tuple[list[list[Point]], list[list[Point]]]:
    """(rings, lines): directed parts linked as far as they go."""
    ends = defaultdict(int)
    for p in parts:
        ends[p[0]] += 1
        ends[p[-1]] -= 1
    at: dict[Point, list] = defaultdict(list)
    for p in sorted(parts, reverse=True):
        at[p[0]].append(p)
    lines = []
    for first, n in sorted((v, n) for v, n in ends.items() if n > 0):
        for _ in range(n):
            line = list(at[first].pop())
            while ends[line[-1]] >= 0 and at[line[-1]]:
                here, came = line[-1], line[-2]
                back = math.atan2(came[1] - here[1], came[0] - here[0])
                turn = lambda p, back=back, here=here: ((back - math.atan2(p[1][1] - here[1], p[1][0] - here[0])) % math.tau or math.tau, p)
                go = min(at[here], key=turn)
                at[here].remove(go)
                line += go[1:]
            ends[line[-1]] += 1  # another line goes on through here
            lines.append(line)
    return link_rings([p for ps in at.values() for p in ps]), lines


def _inside(operation: str, names: list, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[str | None, str | None, np.ndarray, np.ndarray]]:
    """Each result of a cell with where it is, left and right of each piece."""
    first = [k for k, (side, _) in enumerate(names) if side == 0]
    second = [k for k, (side, _) in enumerate(names) if side == 1]
    ins = (left != 0, right != 0)
    other = [x[:, second].any(axis=1) for x in ins]
    for k in first:
        if operation == "intersection":
            for m in second:
                yield names[k][1], names[m][1], *(x[:, k] & x[:, m] for x in ins)
        elif operation == "difference":
            yield names[k][1], None, *(x[:, k] & ~o for x, o in zip(ins, other, strict=True))
        else:
            yield names[k][1], None, *(x[:, k] for x in ins)


def _lines(pieces: DataFrame, corners: DataFrame, operation: str, cell: float, tasks: int) -> DataFrame:
    """(a, b, cx, cy, closed, line): the results' borders inside each cell.
    Cells are independent; a square of them goes to one call."""
    none = F.lit(None).cast("double")
    both = pieces.withColumn("winding", F.lit(None).cast("long")).unionByName(
        corners.select("side", "key", none.alias("ax"), none.alias("ay"), none.alias("bx"), none.alias("by"), "cx", "cy", F.col("winding").cast("long").alias("winding"))
    )

    def one_cell(pdf: pd.DataFrame, i: int, j: int) -> list[tuple]:
        names = list(zip(pdf["side"].tolist(), pdf["key"].tolist(), strict=True))
        is_corner = pdf["winding"].notna().to_numpy()
        corner = {names[k]: int(pdf["winding"].iloc[k]) for k in np.flatnonzero(is_corner)}
        at = np.flatnonzero(~is_corner)
        a, b = pdf[["ax", "ay"]].to_numpy()[at], pdf[["bx", "by"]].to_numpy()[at]
        parts, regions, left, right = windings([names[k] for k in at], a, b, corner, grid_line(i, cell))
        rows = []
        for one, two, l, r in _inside(operation, regions, left, right):  # noqa: E741
            edge = np.flatnonzero(l != r)
            if len(edge):
                rings, open_lines = chains([parts[k] if l[k] else parts[k][::-1] for k in edge])
                rows += [(one, two, i, j, closed, [{"x": x, "y": y} for x, y in line]) for closed, lines in ((True, rings), (False, open_lines)) for line in lines]
        return rows

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [r for (i, j), one in pdf.groupby(["cx", "cy"]) for r in one_cell(one, int(i), int(j))]
        return pd.DataFrame(rows, columns=["a", "b", "cx", "cy", "closed", "line"])

    both = both.withColumn("sx", F.floor(F.col("cx") / SQUARE)).withColumn("sy", F.floor(F.col("cy") / SQUARE))
    return both.repartition(tasks, "sx", "sy").groupBy("sx", "sy").applyInPandas(lambda pdf: work(pdf), f"a string, b string, cx long, cy long, closed boolean, line {_LINE}")


def _link(lines: DataFrame, tasks: int) -> DataFrame:
    """(a, b, line): closed rings, put together in blocks of growing size. The
    first blocks are small, so a call takes all regions of one; later ones are
    taken by region."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([one_region(x) for _, x in pdf.groupby(["a", "b"], dropna=False)])

    def one_region(pdf: pd.DataFrame) -> pd.DataFrame:
        rings, open_lines = chains([tuple((p["x"], p["y"]) for p in line) for line in pdf["line"]])
        rows = [(closed, [{"x": x, "y": y} for x, y in line]) for closed, lines in ((True, rings), (False, open_lines)) for line in lines]
        same = {c: pdf[c].iloc[0] for c in ("a", "b", "cx", "cy")}
        return pd.DataFrame([(same["a"], same["b"], same["cx"], same["cy"], *r) for r in rows], columns=["a", "b", "cx", "cy", "closed", "line"])

    done = lines.where("closed").select("a", "b", "line")
    left, by = lines.where("not closed"), ["cx", "cy"]
    while not left.isEmpty():
        block = left.withColumn("cx", F.floor(F.col("cx") / BLOCK)).withColumn("cy", F.floor(F.col("cy") / BLOCK))
        whole = block.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
        if whole[1] - whole[0] <= 1 and whole[3] - whole[2] <= 1:  # floors of -1 and 0 never meet
            block = block.withColumn("cx", F.lit(0).cast("long")).withColumn("cy", F.lit(0).cast("long"))
        made = cut(block.repartition(tasks, *by).groupBy(*by).applyInPandas(lambda pdf: work(pdf), f"a string, b string, cx long, cy long, closed boolean, line {_LINE}"))
        done = done.unionByName(made.where("closed").select("a", "b", "line"))
        if whole[1] - whole[0] <= 1 and whole[3] - whole[2] <= 1:
            break
        left, by, tasks = made.where("not closed"), ["a", "b", "cx", "cy"], max(tasks // BLOCK, 8)
    return done


def tidy(ring: list[Point]) -> list[Point]:
    """A ring without the vertices that the grid's lines left in its sides."""
    out: list[Point] = []
    for k, p in enumerate(ring):
        if round(p[0], DECIMALS) != p[0] or round(p[1], DECIMALS) != p[1]:
            (ax, ay), (bx, by) = out[-1] if out else ring[-1], ring[(k + 1) % len(ring)]
            size = math.hypot(bx - ax, by - ay)
            if size and abs((p[0] - ax) * (by - ay) - (p[1] - ay) * (bx - ax)) <= 4 * NEAR * size:
                continue
        out.append(p)
    return out


def _rings(lines: DataFrame) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rings = [tidy([(p["x"], p["y"]) for p in line]) for line in pdf["line"]]
            area = [signed_area(r) for r in rings]
            good = [k for k, (r, s) in enumerate(zip(rings, area, strict=True)) if len(r) > 2 and s]
            yield pd.DataFrame({"a": [pdf["a"].iloc[k] for k in good], "b": [pdf["b"].iloc[k] for k in good], "ring": [[{"x": x, "y": y} for x, y in rings[k]] for k in good], "area": [area[k] for k in good]}, columns=["a", "b", "ring", "area"])

    return lines.select("a", "b", "line").mapInPandas(work, f"a string, b string, ring {_LINE}, area double")


def overlay(a: DataFrame, a_key: str, b: DataFrame | None, b_key: str | None, operation: str) -> DataFrame:
    """(a, b, ring, area): the rings of each result, one a row, the inside to
    their left; holes have negative areas. ``operation``: "intersection" of
    each region of ``a`` with each of ``b``, "difference" of each region of
    ``a`` and all of ``b``, or "valid", each region of ``a`` alone."""
    sides = layer_sides(a, a_key, 0)
    if b is not None:
        sides = sides.unionByName(layer_sides(b, b_key, 1))
    sides = cut(sides)
    n, west, east, south, north = sides.agg(F.count("*"), F.min("ax"), F.max("ax"), F.min("ay"), F.max("ay")).first()
    if not n:
        return sides.select(F.col("key").alias("a"), F.col("key").alias("b"), F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))).alias("ring"), F.col("ax").alias("area")).limit(0)
    cell = max(round(math.sqrt(max((east - west) * (north - south), 1e-6) / max(1.0, n / PER_CELL)), DECIMALS), 1e-6)
    tasks = n // PER_TASK + 1
    pieces = cut(_pieces(sides.repartition(tasks), cell))
    return _rings(_link(cut(_lines(pieces, _corners(pieces, cell), operation, cell, tasks)), tasks))


def intersection(a: DataFrame, b: DataFrame, a_key: str = "key", b_key: str = "key") -> DataFrame:
    return overlay(a, a_key, b, b_key, "intersection")


def difference(a: DataFrame, b: DataFrame, a_key: str = "key", b_key: str = "key") -> DataFrame:
    return overlay(a, a_key, b, b_key, "difference").drop("b")


def make_valid(a: DataFrame, key: str = "key") -> DataFrame:
    """Regions whose rings don't cross themselves or each other."""
    return overlay(a, key, None, None, "valid").drop("b")


def frame(like: DataFrame, lim: Limits) -> DataFrame:
    """The map's rectangle as a layer of one region, "map"."""
    corners = [(lim.west + x * lim.width, lim.south + y * lim.height) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])
    return like.sparkSession.range(1).select(F.lit("map").alias("key"), F.array(ring).alias("rings"))


def clip(a: DataFrame, lim: Limits, key: str = "key") -> DataFrame:
    """The parts of each region inside a rectangle; valid, too."""
    return overlay(a, key, frame(a, lim), "key", "intersection").drop("b")


def regions(rings: DataFrame, key: str = "a") -> DataFrame:
    """(key, rings, area): a region's rings in one row, its outlines first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("s"), "ring")))
    out = rings.groupBy(F.col(key).alias("key")).agg(ordered.alias("r"), F.sum("area").alias("area"))
    return out.select("key", F.transform("r", lambda x: x["ring"]).alias("rings"), "area")


def coast(tiles: DataFrame, ocean: Column, land_mass: str, lim: Limits, curve: float | None = 100.0) -> DataFrame:
    """(kind, name, ring, area): the rings of every land mass, cut to the map,
    and of the ocean, the map without them; one ring a row, holes negative."""
    land = dissolve(tiles.where(~ocean), land_mass, curve).select(F.col("theme").alias("key"), "rings")
    land = cut(clip(land, lim))
    again = land.select(F.col("a").alias("key"), F.array("ring").alias("rings"))
    sea = difference(frame(tiles, lim), again)
    return land.select(F.lit("land").alias("kind"), F.col("a").alias("name"), "ring", "area").unionByName(sea.select(F.lit("ocean").alias("kind"), F.lit("ocean").alias("name"), "ring", "area"))


def region_outlines(tiles: DataFrame, theme: str, lim: Limits, curve: float | None = 100.0) -> DataFrame:
    """(theme, rings, area): outlines with shared borders curved once, made
    valid and cut to the map."""
    rows = curvify(tiles, theme, curve).select(F.col("theme").alias("key"), "rings")
    return regions(clip(rows, lim)).withColumnRenamed("key", "theme")
