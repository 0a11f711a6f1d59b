"""Planar and spherical point functions as Columns, and the same on numbers
for kernels. Longitudes and latitudes are degrees; spherical distances are
degrees of arc, bearings 0 to 360 clockwise from north."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column, sphere: bool = False) -> Column:
    if not sphere:
        return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    a, b = F.radians(y1), F.radians(y2)
    h = F.pow(F.sin((b - a) / 2), 2.0) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2.0)
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def bearing(x1: Column, y1: Column, x2: Column, y2: Column, sphere: bool = False) -> Column:
    if not sphere:
        return F.pmod(F.lit(450.0) - F.round(F.degrees(F.atan2(y2 - y1, x2 - x1))), F.lit(360.0))
    a, b, d = F.radians(y1), F.radians(y2), F.radians(x2 - x1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360.0, F.lit(360.0))


def across_antimeridian(x: Column, to: Column) -> Column:
    """Longitude of a point on the other side of the map's edge as seen from ``to``."""
    return F.when(to > 0, x + 360.0).otherwise(x - 360.0)


def midpoint(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def sphere_midpoint(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Middle of the great circle between two points."""
    a, b, d = F.radians(y1), F.radians(y2), F.radians(x2 - x1)
    east, north = F.cos(b) * F.cos(d), F.cos(b) * F.sin(d)
    side = F.cos(a) + east
    lat = F.atan2(F.sin(a) + F.sin(b), F.sqrt(side * side + north * north))
    return x1 + F.degrees(F.atan2(north, side)), F.degrees(lat)


def interpolate_at_longitude(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, sphere: bool = False) -> Column:
    """Latitude at which the line between two points passes a longitude."""
    if not sphere:
        return y1 + (y2 - y1) * (x - x1) / (x2 - x1)
    tan, sin = (lambda v: F.tan(F.radians(v))), (lambda v: F.sin(F.radians(v)))
    return F.degrees(F.atan((tan(y1) * sin(x2 - x) + tan(y2) * sin(x - x1)) / sin(x2 - x1)))


def to_edge(x: Column, y: Column, edge: Column, west: float, south: float, width: float, height: float) -> tuple[Column, Column]:
    """The point moved straight to an edge of the map, or to a corner of it."""
    name = F.lower(edge)
    at_x = F.when(name.endswith("west"), F.lit(float(west))).when(name.endswith("east"), F.lit(float(west + width))).otherwise(x)
    at_y = F.when(name.startswith("north"), F.lit(float(south + height))).when(name.startswith("south"), F.lit(float(south))).otherwise(y)
    return at_x, at_y


def add(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] + b[0], a[1] + b[1]


def subtract(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] - b[0], a[1] - b[1]


def multiply(a: tuple[Column, Column], factor: Column | float) -> tuple[Column, Column]:
    return a[0] * factor, a[1] * factor


def perpendicular(a: tuple[Column, Column]) -> tuple[Column, Column]:
    """A quarter turn to the left."""
    return -a[1], a[0]


def angle_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d > 180, 360 - d).otherwise(d)


def normalized(x: Column, y: Column) -> tuple[Column, Column]:
    size = F.sqrt(x * x + y * y)
    return x / size, y / size


def circumcenter(ax, ay, bx, by, cx, cy):
    """Works on Columns, numbers and arrays alike."""
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return (a * (by - cy) + b * (cy - ay) + c * (ay - by)) / d, (a * (cx - bx) + b * (ax - cx) + c * (bx - ax)) / d


def ring_area(xs: Column, ys: Column) -> Column:
    """Planar area of a closed ring given as two arrays of vertices."""
    n = F.size(xs)
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + F.get(xs, i) * F.get(ys, F.pmod(i + 1, n)) - F.get(xs, F.pmod(i + 1, n)) * F.get(ys, i))) / 2


#: Fixed value: the divisor that scales spherical areas to map units.
SPHERE_AREA_DIVISOR = 12392029000.0
#: Fixed value: the earth's equatorial radius in metres, as the area formula takes it.
EARTH_RADIUS = 6378137.0


def sphere_ring_area(ring: list[tuple[float, float]]) -> float:
    """Area of a ring on the sphere by the trapezoid rule in sin(latitude)."""
    total, n = 0.0, len(ring)
    for k in range(n):
        (x0, _), (_, y1), (x2, _) = ring[k - 1], ring[k], ring[(k + 1) % n]
        total += math.radians(x2 - x0) * math.sin(math.radians(y1))
    return abs(total * EARTH_RADIUS**2 / 2) / SPHERE_AREA_DIVISOR


def clip_antimeridian(line: list[tuple[float, float]], west: float = -180.0, width: float = 360.0) -> list[list[tuple[float, float]]]:
    """Split a line that leaves the map through its east or west edge; each
    part is shifted onto the map."""
    east = west + width
    parts, cur = [], []
    shift = 0.0
    for k, (x, y) in enumerate(line):
        if not cur:
            shift = -width if x > east else width if x < west else 0.0
            cur.append((x + shift, y))
            continue
        px, py = line[k - 1]
        while not west <= x + shift <= east:
            edge = east if x + shift > east else west
            at = edge - shift
            yy = py + (y - py) * (at - px) / (x - px)
            cur.append((edge, yy))
            parts.append(cur)
            shift += -width if edge == east else width
            cur = [(at + shift, yy)]
        cur.append((x + shift, y))
    if cur:
        parts.append(cur)
    return parts


def is_off_by_parity(x: Column) -> Column:
    """True for numbers whose remainder by two, with their sign, is under one."""
    return (x % 2.0) < 1.0
