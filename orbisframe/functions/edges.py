"""Compass edges of the map: algebra, and classification of points and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight edges with their bearing and unit steps (east, north).
EDGES = {
    "North": (0, 0, 1), "Northeast": (45, 1, 1), "East": (90, 1, 0), "Southeast": (135, 1, -1),
    "South": (180, 0, -1), "Southwest": (225, -1, -1), "West": (270, -1, 0), "Northwest": (315, -1, 1),
}
_BY_STEP = {(dx, dy): name for name, (_, dx, dy) in EDGES.items()}


def _choose(col: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col)


def opposite(edge: Column) -> Column:
    return _choose(edge, {n: _BY_STEP[-dx, -dy] for n, (_, dx, dy) in EDGES.items()})


def direction(edge: Column) -> Column:
    return _choose(edge, {n: d for n, (d, _, _) in EDGES.items()})


def _join(a: str, b: str) -> str | None:
    (_, ax, ay), (_, bx, by) = EDGES[a], EDGES[b]
    if ax * bx < 0 or ay * by < 0:
        return None
    return _BY_STEP[ax or bx, ay or by]


def combine(a: Column, b: Column) -> Column:
    """Edge that lies on both; opposite ones are an error."""
    key = F.concat(a, F.lit("+"), b)
    got = _choose(key, {f"{x}+{y}": z for x in EDGES for y in EDGES if (z := _join(x, y))})
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.coalesce(got, F.raise_error(F.concat(F.lit("edges in conflict: "), key))))


def contains(a: Column, b: Column) -> Column:
    """True if edge ``a`` takes in ``b``: the same, or a side of the corner."""
    key = F.concat(a, F.lit("+"), b)
    yes = [f"{x}+{y}" for x in EDGES for y in EDGES if x == y or _join(x, y) == x]
    return key.isin(yes)


def extent_contains(x: Column, y: Column, west: float, south: float, width: float, height: float) -> Column:
    return (x >= west) & (x <= west + width) & (y >= south) & (y <= south + height)


def point_on_edge(x: Column, y: Column, west: float, south: float, width: float, height: float) -> Column:
    side = F.when(y == south + height, "North").when(y == south, "South")
    across = F.when(x == west, "West").when(x == west + width, "East")
    return F.when(side.isNull(), across).when(across.isNull(), side).otherwise(F.concat(side, F.lower(across)))


def box_on_edge(x_min: Column, y_min: Column, x_max: Column, y_max: Column, west: float, south: float, width: float, height: float) -> Column:
    """Edge of the map that a box touches; null inside, and for one that
    touches opposite sides the side across counts (north before south)."""
    side = F.when(y_max >= south + height, "North").when(y_min <= south, "South")
    across = F.when(x_min <= west, "West").when(x_max >= west + width, "East")
    return F.when(side.isNull(), across).when(across.isNull(), side).otherwise(F.concat(side, F.lower(across)))


def open_edge(edge: Column, wraps: bool, north_pole: bool, south_pole: bool) -> Column:
    """What of an edge lies beside nothing: sides that wrap have neighbours
    across the map, and nothing leaves it over a pole."""
    low = F.lower(edge)
    side = F.when(low.startswith("north") & F.lit(not north_pole), "North").when(low.startswith("south") & F.lit(not south_pole), "South")
    across = F.when(low.endswith("west") & F.lit(not wraps), "West").when(low.endswith("east") & F.lit(not wraps), "East")
    return F.when(side.isNull(), across).when(across.isNull(), side).otherwise(F.concat(side, F.lower(across)))
