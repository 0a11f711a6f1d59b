"""Terrain tasks: each takes tiles and returns tiles with new elevations.

Tiles have fid, site_x, site_y, elevation and grouping; neighbour tasks also
take the edge table (src, dst). Random tasks draw from the stream they are
given, those of single rows by fid.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisframe.functions.near import Near
from orbisframe.functions.rand import between, uniform, whole
from orbisframe.functions.rand import stream as streams
from orbisframe.operators import graph
from orbisframe.session import cut

# How far a hill spreads, by the largest number of tiles it holds for.
BLOB_POWERS = (
    (1001, 0.93), (2001, 0.95), (5001, 0.97), (10001, 0.98), (20001, 0.99), (30001, 0.991), (40001, 0.993),
    (50001, 0.994), (60001, 0.995), (70001, 0.9955), (80001, 0.996), (90001, 0.9964), (100001, 0.9973), (None, 0.998),
)
# The same of a mountain range.
LINE_POWERS = (
    (1001, 0.75), (2001, 0.77), (5001, 0.79), (10001, 0.81), (20001, 0.82), (30001, 0.83), (40001, 0.84),
    (50001, 0.86), (60001, 0.87), (70001, 0.88), (80001, 0.91), (90001, 0.92), (100001, 0.93), (None, 0.94),
)


@dataclass(frozen=True)
class Limits:
    """Elevation limits and map extent."""

    low: float = -11000.0
    high: float = 9000.0
    west: float = -180.0
    south: float = -90.0
    width: float = 360.0
    height: float = 180.0


def _power(n: int, table: tuple) -> float:
    return next(power for most, power in table if most is None or n <= most)


def blob_power(n_tiles: int) -> float:
    return _power(n_tiles, BLOB_POWERS)


def line_power(n_tiles: int) -> float:
    return _power(n_tiles, LINE_POWERS)


def relative_height(percent: float, lim: Limits, mode: Callable[[float], float] = lambda v: v) -> float:
    """Metres of a percentage: of the highest point above zero, of the lowest
    below it. ``mode`` rounds the fraction (floor and ceil in filters)."""
    if percent in (100, -100):
        return lim.high if percent > 0 else lim.low
    part = mode(percent / 100)
    return part * lim.high if percent >= 0 else -part * lim.low if lim.low < 0 else 0.0


@dataclass(frozen=True)
class Span:
    """A numeric range of a task: inclusive, half-open, or one number."""

    low: float
    high: float
    inclusive: bool = True

    @staticmethod
    def parse(text: str | float) -> "Span":
        if isinstance(text, int | float):
            return Span(float(text), float(text))
        if "..=" in text:
            a, b = text.split("..=")
            return Span(float(a), float(b))
        if ".." in text:
            a, b = text.split("..")
            return Span(float(a), float(b), False)
        return Span(float(text), float(text))

    def holds(self, c: Column) -> Column:
        return (c >= self.low) & ((c <= self.high) if self.inclusive else (c < self.high))

    def draw(self, tag: str, key: Column | str) -> Column:
        return between(tag, key, self.low, self.high)


def height_filter(span: Span | None, lim: Limits, c: Column | None = None) -> Column:
    """Filter on percent heights. Fractions are floored and ceiled before they
    become metres, so bounds are the lowest point, zero or the highest."""
    c = F.col("elevation") if c is None else c
    if span is None:
        return Span(lim.low, lim.high).holds(c)
    clamp = lambda v: min(max(v, lim.low), lim.high)
    return Span(clamp(relative_height(span.low, lim, math.floor)), clamp(relative_height(span.high, lim, math.ceil)), span.inclusive).holds(c)


def clamp(c: Column, lim: Limits) -> Column:
    return F.greatest(F.lit(lim.low), F.least(F.lit(lim.high), c))


def scaled(c: Column, lim: Limits) -> Column:
    up, down = 80.0 / lim.high, 20.0 / abs(lim.low) if lim.low < 0 else 0.0
    v = F.when(c >= 0, 20 + F.floor(c * up)).otherwise(20 - F.floor(F.abs(c) * down))
    return F.greatest(F.lit(0), F.least(F.lit(100), v)).cast("int")


def elevation_scale(tiles: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """Clamp elevations and recompute elevation_scaled: the end of every task list."""
    return tiles.withColumn("elevation", clamp(F.col("elevation"), lim)).withColumn("elevation_scaled", scaled(F.col("elevation"), lim))


def add(tiles: DataFrame, delta_percent: float, span: Span | None = None, lim: Limits = Limits()) -> DataFrame:
    delta = math.copysign(relative_height(abs(delta_percent), lim), delta_percent)
    return tiles.withColumn("elevation", F.when(height_filter(span, lim), clamp(F.col("elevation") + delta, lim)).otherwise(F.col("elevation")))


def multiply(tiles: DataFrame, factor: float, span: Span | None = None, lim: Limits = Limits()) -> DataFrame:
    return tiles.withColumn("elevation", F.when(height_filter(span, lim), clamp(F.col("elevation") * factor, lim)).otherwise(F.col("elevation")))


def clear(tiles: DataFrame, lim: Limits = Limits()) -> DataFrame:
    return multiply(tiles, 0.0, None, lim)


def clear_ocean(tiles: DataFrame, grouping: str = "grouping") -> DataFrame:
    return tiles.withColumn(grouping, F.when(F.col(grouping) == "Ocean", F.lit("Continent")).otherwise(F.col(grouping)))


def fill_ocean(tiles: DataFrame, grouping: str = "grouping") -> DataFrame:
    return tiles.withColumn(grouping, F.when(F.col("elevation") < 0, F.lit("Ocean")).otherwise(F.col(grouping)))


def random_uniform(tiles: DataFrame, delta: Span, span: Span | None = None, lim: Limits = Limits(), stream: str = "") -> DataFrame:
    """Add a random share of the heights between the two deltas."""
    low, high = (math.copysign(relative_height(abs(v), lim), v) for v in (delta.low, delta.high))
    return tiles.withColumn("elevation", F.when(height_filter(span, lim), clamp(F.col("elevation") + between(f"{stream}ru", "fid", low, high), lim)).otherwise(F.col("elevation")))


def mask(tiles: DataFrame, power: float = 1.0, lim: Limits = Limits()) -> DataFrame:
    """Lower towards the map's border (negative power: towards its middle)."""
    factor = abs(power) if abs(power) >= 1 else 1.0
    nx, ny = 2 * (F.col("site_x") - lim.west) / lim.width - 1, 2 * (F.col("site_y") - lim.south) / lim.height - 1
    near = (1 - nx * nx) * (1 - ny * ny)
    near = 1 - near if power < 0 else near
    masked = F.col("elevation") * near
    return tiles.withColumn("elevation", clamp((F.col("elevation") * (factor - 1) + masked) / factor, lim))


def smooth(tiles: DataFrame, edges: DataFrame, fr: float = 2.0, lim: Limits = Limits()) -> DataFrame:
    """Mean of a tile and its neighbours, blended by ``fr``. One join on the
    edge table and one aggregate; the mean is summed in id order, so it doesn't
    depend on how rows arrive."""
    height = tiles.select(F.col("fid").alias("dst"), F.col("elevation").alias("h"))
    near = edges.join(height, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "h"))).alias("hs"))
    total = F.aggregate(F.coalesce("hs", F.array().cast("array<struct<dst:bigint,h:double>>")), F.col("elevation"), lambda s, x: s + x["h"])
    mean = total / (1 + F.coalesce(F.size("hs"), F.lit(0)))
    new = mean if fr == 1 else clamp((F.col("elevation") * (fr - 1) + mean) / fr, lim)
    return tiles.join(near, tiles["fid"] == near["src"], "left").withColumn("elevation", new).drop("src", "hs")


def _spacing(sites: DataFrame) -> float:
    """Width of a grid cell with about two sites, 0 if they have no extent."""
    n, dx, dy = sites.agg(F.count("*"), F.max("site_x") - F.min("site_x"), F.max("site_y") - F.min("site_y")).first()
    return 1.5 * math.sqrt(dx * dy / n) if n and dx and dy else 0.0


def _candidates(points: DataFrame, sites: DataFrame, size: float) -> DataFrame:
    """(key, fid, d): each point with the sites of its grid cell and of those around it."""
    at = lambda c: F.floor(F.col(c) / size)
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    near = points.select("key", "x", "y", F.explode(steps).alias("s")).select("key", "x", "y", (at("x") + F.col("s.dx")).alias("gx"), (at("y") + F.col("s.dy")).alias("gy"))
    d = (F.col("site_x") - F.col("x")) * (F.col("site_x") - F.col("x")) + (F.col("site_y") - F.col("y")) * (F.col("site_y") - F.col("y"))
    return near.join(sites.withColumn("gx", at("site_x")).withColumn("gy", at("site_y")), ["gx", "gy"]).select("key", "fid", d.alias("d"))


def nearest_tile(points: DataFrame, tiles: DataFrame, cell: float) -> DataFrame:
    """Nearest tile of each point (key, x, y), the smallest fid of equally near
    ones: candidates from the point's grid cell and those around it, so the
    join is on equal cells. Cells begin at the sites' own spacing; a point
    whose nearest candidate isn't within a cell's width looks again in cells
    of twice the width. ``cell``, the widest, must be at least the largest
    distance of a point from its nearest site."""
    sites = cut(tiles.select("fid", "site_x", "site_y"))
    size = min(cell, _spacing(sites) or cell)
    found = None
    while True:
        got = _candidates(points, sites, size).groupBy("key").agg(F.min_by("fid", F.struct("d", "fid")).alias("fid"), F.min("d").alias("d2"))
        if size >= cell:
            return got if found is None else found.unionByName(got)
        # all sites within a cell's width have been candidates; the margin is for rounding
        got = cut(got.where(F.col("d2") <= (0.999 * size) ** 2))
        found = got if found is None else found.unionByName(got)
        points = cut(points.select("key", "x", "y").join(got.select(F.col("key").alias("_key")), F.col("key").eqNullSafe(F.col("_key")), "left_anti"))
        if points.isEmpty():
            return found
        size = min(cell, 2 * size)


def invert(tiles: DataFrame, probability: float, axes: str = "xy", lim: Limits = Limits(), cell: float = 20.0, stream: str = "") -> DataFrame:
    """With the given probability (one draw for the map) every tile takes the
    elevation of the tile nearest to its mirror point."""
    flip = F.col("_u") < probability
    x = 2 * lim.west + lim.width - F.col("site_x") if "x" in axes else F.col("site_x")
    y = 2 * lim.south + lim.height - F.col("site_y") if "y" in axes else F.col("site_y")
    points = tiles.select(F.col("fid").alias("key"), x.alias("x"), y.alias("y"))
    twin = nearest_tile(points, tiles, cell).select("key", F.col("fid").alias("twin"))
    height = tiles.select(F.col("fid").alias("twin"), F.col("elevation").alias("other"))
    out = tiles.join(twin.join(height, "twin"), tiles["fid"] == F.col("key"), "left").withColumn("_u", uniform(f"{stream}inv", F.lit(0)))
    return out.withColumn("elevation", F.when(flip & F.col("other").isNotNull(), F.col("other")).otherwise(F.col("elevation"))).drop("key", "twin", "other", "_u")


def pixel_of(lim: Limits, columns: int, rows: int) -> tuple[Column, Column]:
    """Pixel of a site, clamped to the raster."""
    px, py = F.floor((F.col("site_x") - lim.west) / (lim.width / columns)), F.floor((F.col("site_y") - lim.south) / (lim.height / rows))
    return F.greatest(F.lit(0), F.least(F.lit(columns - 1), px)), F.greatest(F.lit(0), F.least(F.lit(rows - 1), py))


def raster_sample(tiles: DataFrame, raster: DataFrame, columns: int, rows: int, lim: Limits = Limits()) -> DataFrame:
    """Tiles with ``sample``, the value of their pixel (null: no data)."""
    px, py = pixel_of(lim, columns, rows)
    r = raster.select(F.col("px").alias("_px"), F.col("py").alias("_py"), F.col("value").alias("sample"))
    out = tiles.withColumn("_x", px).withColumn("_y", py)
    return out.join(r, (F.col("_x") == F.col("_px")) & (F.col("_y") == F.col("_py")), "left").drop("_x", "_y", "_px", "_py")


def sample_elevation(tiles: DataFrame, raster: DataFrame, columns: int, rows: int, lim: Limits = Limits()) -> DataFrame:
    return raster_sample(tiles, raster, columns, rows, lim).withColumn("elevation", F.coalesce("sample", "elevation")).drop("sample")


def sample_ocean_masked(tiles: DataFrame, raster: DataFrame, columns: int, rows: int, lim: Limits = Limits(), grouping: str = "grouping") -> DataFrame:
    got = raster_sample(tiles, raster, columns, rows, lim)
    return got.withColumn(grouping, F.when(F.col("sample").isNotNull(), F.lit("Ocean")).otherwise(F.col(grouping))).drop("sample")


def sample_ocean_below(tiles: DataFrame, raster: DataFrame, columns: int, rows: int, level: float, lim: Limits = Limits(), grouping: str = "grouping") -> DataFrame:
    got = raster_sample(tiles, raster, columns, rows, lim)
    return got.withColumn(grouping, F.when(F.col("sample") < level, F.lit("Ocean")).otherwise(F.col(grouping))).drop("sample")


# Order-dependent tasks run as one kernel over the map: the visiting order is
# part of their meaning.


def _kernel(tiles: DataFrame, edges: DataFrame, fn: Callable[[pd.DataFrame, Near], pd.DataFrame], changed: str = "elevation") -> DataFrame:
    """``tiles`` with the column ``changed`` as ``fn`` makes it, from the
    numbers that it reads and the neighbours in flat arrays."""
    near = edges.where("dst is not null").groupBy("src").agg(F.array_sort(F.collect_list(F.col("dst").cast("long"))).alias("_near"))
    reads = list(dict.fromkeys(("fid", "site_x", "site_y", "elevation", changed)))
    rows = tiles.select(*reads).join(near, F.col("fid") == near["src"], "left").drop("src")
    kind = dict(tiles.dtypes)

    def work(table: pa.Table) -> pa.Table:
        order, near = Near.of(np.asarray(table.column("fid")), table.column("_near"))
        pdf = table.select(reads).to_pandas().iloc[order].reset_index(drop=True)
        del table
        return pa.Table.from_pandas(fn(pdf, near)[["fid", changed]], preserve_index=False)

    new = rows.groupBy(F.lit(0).alias("_one")).applyInArrow(lambda table: work(table), f"fid {kind['fid']}, {changed} {kind[changed]}")
    new = new.select(F.col("fid").alias("_f"), F.col(changed).alias("_new"))
    return tiles.join(new, F.col("fid") == F.col("_f")).select(*[F.col("_new").alias(c) if c == changed else F.col(c) for c in tiles.columns])


def _rng(stream: str, tag: str) -> np.random.Generator:
    return np.random.default_rng(int(hashlib.md5(f"{stream}{tag}".encode()).hexdigest()[:15], 16))


def _start_tiles(pdf: pd.DataFrame, x: Span, y: Span, lim: Limits) -> np.ndarray:
    fx, fy = (pdf["site_x"] - lim.west) / lim.width * 100, (pdf["site_y"] - lim.south) / lim.height * 100
    return np.flatnonzero((fx >= x.low) & (fx <= x.high) & (fy >= y.low) & (fy <= y.high))


_ALL = Span(0, 100)


def add_hill(tiles: DataFrame, edges: DataFrame, count: int, delta: Span, x: Span = _ALL, y: Span = _ALL, lim: Limits = Limits(), stream: str = "", grouping: str = "grouping") -> DataFrame:
    """Blobs: a random start is raised, and each ring around it by a power of
    the ring before with a random factor, until the rise is at most 1."""

    def work(pdf: pd.DataFrame, near: Near) -> pd.DataFrame:
        rng, power = _rng(stream, "hill"), blob_power(len(pdf))
        h = pdf["elevation"].to_numpy(float).copy()
        starts = _start_tiles(pdf, x, y, lim)
        for _ in range(count if len(starts) else 0):
            pick = rng.uniform(delta.low, delta.high)
            rise, sign = abs(pick) / 100 * lim.high, math.copysign(1, pick)
            for _ in range(50):
                s = int(rng.choice(starts))
                if lim.low * 0.9 <= h[s] + sign * rise <= lim.high * 0.9:
                    break
            change, used, queue, done = array("d", [rise]), bytearray(len(h)), array("q", [s]), 0
            used[s] = 1
            while done < len(queue):
                for n in near[queue[done]]:
                    if not used[n]:
                        grown = change[done] ** power * rng.uniform(0.9, 1.1)
                        if grown > 1:
                            used[n] = 1
                            change.append(grown)
                            queue.append(n)
                done += 1
            at = np.frombuffer(queue, np.int64)
            h[at] = np.clip(h[at] + sign * np.frombuffer(change), lim.low, lim.high)
        return pdf.assign(elevation=h)

    return _kernel(tiles, edges, work)


def _walk(pdf: pd.DataFrame, near: Near, start: int, end: int, miss: float, rng: np.random.Generator) -> list[int]:
    """Greedy path by distance; with probability ``miss`` a step's distance is halved, which makes it jagged."""
    xs, ys = pdf["site_x"].to_numpy(), pdf["site_y"].to_numpy()
    path, used, cur = [start], {start}, start
    while cur != end:
        best = None
        for n in near[cur]:
            if n == end:
                best = (0.0, n)
                break
            if n in used:
                continue
            d = math.hypot(xs[n] - xs[end], ys[n] - ys[end])
            if rng.random() < miss:
                d /= 2
            if best is None or (d, n) < best:
                best = (d, n)
        if best is None:
            break
        cur = best[1]
        used.add(cur)
        path.append(cur)
    return path


def add_range(tiles: DataFrame, edges: DataFrame, count: int, delta: Span, x: Span = _ALL, y: Span = _ALL, lim: Limits = Limits(), stream: str = "", grouping: str = "grouping") -> DataFrame:
    """Ranges: a jagged ridge is raised, its sides by decaying heights, and at
    every sixth ridge tile a spur runs downhill."""

    def work(pdf: pd.DataFrame, near: Near) -> pd.DataFrame:
        rng, power = _rng(stream, "range"), line_power(len(pdf))
        h = pdf["elevation"].to_numpy(float).copy()
        starts = _start_tiles(pdf, x, y, lim)
        for _ in range(count if len(starts) else 0):
            pick = rng.uniform(delta.low, delta.high)
            rise, sign = abs(pick) / 100 * lim.high, math.copysign(1, pick)
            ridge = _walk(pdf, near, int(rng.choice(starts)), int(rng.integers(len(pdf))), 0.15, rng)
            used, ring = bytearray(len(h)), list(ridge)
            for k in ridge:
                used[k] = 1
            level, depth = rise, 0
            while ring and level >= 2:
                for k in ring:
                    h[k] = min(max(h[k] + sign * level * rng.uniform(0.85, 1.15), lim.low), lim.high)
                level, depth = level**power - 1, depth + 1
                nxt = []
                for k in ring:
                    for n in near[k]:
                        if not used[n]:
                            used[n] = 1
                            nxt.append(n)
                ring = nxt
            for k in ridge[::6]:
                for _ in range(depth):
                    low = min(near[k], key=lambda n: (h[n], n), default=None)
                    if low is None:
                        break
                    h[low] = (h[k] * 2 + h[low]) / 3
                    k = low
        return pdf.assign(elevation=h)

    return _kernel(tiles, edges, work)


def add_strait(tiles: DataFrame, edges: DataFrame, width: float, vertical: bool = True, lim: Limits = Limits(), stream: str = "", grouping: str = "grouping") -> DataFrame:
    """A path across the map whose rings are lowered by falling exponents."""

    def work(pdf: pd.DataFrame, near: Near) -> pd.DataFrame:
        rng = _rng(stream, "strait")
        h = pdf["elevation"].to_numpy(float).copy()
        xs, ys = pdf["site_x"].to_numpy(), pdf["site_y"].to_numpy()

        def at(px: float, py: float) -> int:
            return int(np.lexsort((np.arange(len(xs)), np.hypot(xs - px, ys - py)))[0])

        if vertical:
            a = at(lim.west + lim.width * rng.uniform(0.3, 0.7), lim.south)
            b = at(lim.west + lim.width * rng.uniform(0.15, 0.85), lim.south + lim.height)
        else:
            a = at(lim.west, lim.south + lim.height * rng.uniform(0.3, 0.7))
            b = at(lim.west + lim.width, lim.south + lim.height * rng.uniform(0.15, 0.85))
        ring = _walk(pdf, near, a, b, 0.2, rng)
        used, rings = bytearray(len(h)), max(1, round(width))
        for t in ring:
            used[t] = 1
        step = 0.1 / rings
        for k in range(rings):
            exp = 0.99 - step * (rings - k)
            for t in ring:
                h[t] = lim.low + max(h[t] - lim.low, 0.0) ** exp
            nxt = []
            for t in ring:
                for n in near[t]:
                    if not used[n]:
                        used[n] = 1
                        nxt.append(n)
            ring = nxt
        return pdf.assign(elevation=h)

    return _kernel(tiles, edges, work)


def erode(tiles: DataFrame, edges: DataFrame, weathering: float = 1000.0, iterations: int = 10, lim: Limits = Limits(), grouping: str = "grouping") -> DataFrame:
    """Each round turns rock into soil and moves it from high tiles to their
    lowest neighbours; the sum of elevations is kept."""

    def work(pdf: pd.DataFrame, near: Near) -> pd.DataFrame:
        h = pdf["elevation"].to_numpy(float).copy()
        for _ in range(iterations):
            soil = np.minimum(np.full(len(h), weathering / iterations), h - lim.low)
            rock = h - soil
            for k in np.lexsort((np.arange(len(h)), -(rock + soil))):
                here = rock[k] + soil[k]
                lower = [n for n in near[k] if rock[n] + soil[n] < here]
                if not lower or soil[k] <= 0:
                    continue
                low = min(rock[n] + soil[n] for n in lower)
                to = [n for n in lower if rock[n] + soil[n] <= low + 2.220446049250313e-16]
                moved = min(soil[k], (here - low) / 2)
                soil[k] -= moved
                for n in to:
                    soil[n] += moved / len(to)
            h = rock + soil
        return pdf.assign(elevation=h)

    return _kernel(tiles, edges, work)


def seed_ocean(tiles: DataFrame, edges: DataFrame, count: int, x: Span = _ALL, y: Span = _ALL, lim: Limits = Limits(), stream: str = "", grouping: str = "grouping") -> DataFrame:
    """From random starts follow the steepest descent to a tile below zero and mark it."""

    def work(pdf: pd.DataFrame, near: Near) -> pd.DataFrame:
        rng = _rng(stream, "seed")
        h, g = pdf["elevation"].to_numpy(float), pdf[grouping].tolist()
        starts = _start_tiles(pdf, x, y, lim)
        for _ in range(count if len(starts) else 0):
            k, seen = int(rng.choice(starts)), set()
            while h[k] >= 0 and k not in seen:
                seen.add(k)
                k = min([*near[k], k], key=lambda n: (h[n], n))
            if h[k] < 0:
                g[k] = "Ocean"
        return pdf.assign(**{grouping: g})

    return _kernel(tiles, edges, work, grouping)


def flood_ocean(tiles: DataFrame, edges: DataFrame, grouping: str = "grouping") -> DataFrame:
    """Ocean spreads through neighbours below zero until nothing changes: what
    can be reached from it over ocean and low ground, part by part of the map."""
    sea = F.coalesce(F.col(grouping) == "Ocean", F.lit(False))
    wet = graph.hops(tiles, edges, sea, sea | F.coalesce(F.col("elevation") < 0, F.lit(False)))
    mark = wet.where("hops is not null").select(F.col("fid").alias("_wet"))
    return tiles.join(mark, tiles["fid"] == F.col("_wet"), "left").withColumn(grouping, F.when(F.col("_wet").isNotNull(), F.lit("Ocean")).otherwise(F.col(grouping))).drop("_wet")


_ROW_TASKS = {
    "Clear": lambda t, e, p, lim: clear(t, lim),
    "ClearOcean": lambda t, e, p, lim: clear_ocean(t),
    "FillOcean": lambda t, e, p, lim: fill_ocean(t),
    "FloodOcean": lambda t, e, p, lim: flood_ocean(t, e),
    "Add": lambda t, e, p, lim: add(t, p["height_delta"], _opt(p), lim),
    "Multiply": lambda t, e, p, lim: multiply(t, p["height_factor"], _opt(p), lim),
    "RandomUniform": lambda t, e, p, lim: random_uniform(t, Span.parse(p["height_delta"]), _opt(p), lim, p["_place"]),
    "Mask": lambda t, e, p, lim: mask(t, p.get("power", 1), lim),
    "Smooth": lambda t, e, p, lim: smooth(t, e, p.get("fr", 2), lim),
    "Invert": lambda t, e, p, lim: invert(t, p["probability"], p.get("axes", "xy").lower().replace("both", "xy"), lim, stream=p["_place"]),
    "Erode": lambda t, e, p, lim: erode(t, e, p.get("weathering_amount", 1000), p.get("iterations", 10), lim),
    "AddHill": lambda t, e, p, lim: add_hill(t, e, _drawn(p, "count"), Span.parse(p["height_delta"]), _axis(p, "x_filter"), _axis(p, "y_filter"), lim, p["_place"]),
    "AddRange": lambda t, e, p, lim: add_range(t, e, _drawn(p, "count"), Span.parse(p["height_delta"]), _axis(p, "x_filter"), _axis(p, "y_filter"), lim, p["_place"]),
    "AddStrait": lambda t, e, p, lim: add_strait(t, e, _drawn(p, "width"), p.get("direction", "Vertical") == "Vertical", lim, p["_place"]),
    "SeedOcean": lambda t, e, p, lim: seed_ocean(t, e, _drawn(p, "count"), _axis(p, "x_filter"), _axis(p, "y_filter"), lim, p["_place"]),
}
_KNOWN = {"task", "height_filter", "height_delta", "height_factor", "power", "fr", "probability", "axes", "weathering_amount", "iterations", "count", "x_filter", "y_filter", "width", "direction", "source", "recipe", "elevation"}


def _opt(p: dict) -> Span | None:
    return Span.parse(p["height_filter"]) if p.get("height_filter") is not None else None


def _axis(p: dict, name: str) -> Span:
    return Span.parse(p[name]) if p.get(name) is not None else _ALL


def _drawn(p: dict, name: str) -> int:
    """A whole number out of a task's range, drawn from the task's stream."""
    span = Span.parse(p.get(name, 1))
    return whole(int(span.low), max(int(span.high) - (not span.inclusive), int(span.low)), p.get("_place", "") + p["task"], name)


def recipe(
    tiles: DataFrame, edges: DataFrame, tasks: list[dict], lim: Limits = Limits(), rasters: dict[str, tuple[DataFrame, int, int]] | None = None, recipes: dict[str, list[dict]] | None = None,
    stream: str = "",
) -> DataFrame:
    """Run a list of tasks, then clamp and scale. Row-local tasks fuse into
    one stage; unknown keys are warned about, unknown tasks are an error.

    ``rasters``: height maps by the name that a task's ``source`` gives, each
    with its columns and rows, for the three sample tasks. ``recipes``: task
    lists by name for tasks that are recipes (``recipe`` names one, or is a
    list itself). Every task draws from a stream of its own: ``stream`` (the
    world's) and its place, so equal tasks differ, and a list that is run
    again in the same stream gives the same heights."""
    return elevation_scale(_run(tiles, edges, tasks, lim, rasters or {}, recipes or {}, stream), lim)


def _run(tiles: DataFrame, edges: DataFrame, tasks: list[dict], lim: Limits, rasters: dict, recipes: dict, place: str) -> DataFrame:
    for k, p in enumerate(tasks):
        if extra := set(p) - _KNOWN:
            warnings.warn(f"{p.get('task')}: keys without meaning: {sorted(extra)}", stacklevel=3)
        at = place + streams(None, k)
        match p["task"]:
            case "Recipe" | "RecipeSet":
                named = p.get("recipe", p.get("source"))
                tiles = _run(tiles, edges, named if isinstance(named, list) else recipes[named], lim, rasters, recipes, at)
            case "SampleOceanMasked":
                tiles = sample_ocean_masked(tiles, *rasters[p["source"]])
            case "SampleOceanBelow":
                tiles = sample_ocean_below(tiles, *rasters[p["source"]], float(p["elevation"]))
            case "SampleElevation":
                tiles = sample_elevation(tiles, *rasters[p["source"]])
            case task:
                tiles = _ROW_TASKS[task](tiles, edges, {**p, "_place": at}, lim)
    return tiles


def changed_rows(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = ("elevation",)) -> DataFrame:
    """Rows of ``after`` that differ from ``before`` in one of the columns."""
    old = before.select("fid", *[F.col(c).alias(f"_old_{c}") for c in columns])
    differs = ~F.col(columns[0]).eqNullSafe(F.col(f"_old_{columns[0]}"))
    for c in columns[1:]:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return after.join(old, "fid").where(differs).select(*after.columns)


