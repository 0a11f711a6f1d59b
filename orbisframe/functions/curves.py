"""Cubic curves through the points of a line."""

from __future__ import annotations

import math

Point = tuple[float, float]


def control_points(line: list[Point]) -> list[tuple[Point, Point, Point, Point]]:
    """(p0, c0, c1, p1) of each piece. The tangent of an inner point is
    parallel to the line between its neighbours; control points lie a third of
    the piece's length along it, at the ends a third towards the other point."""
    tangents: list[Point | None] = [None]
    for (ax, ay), (bx, by) in zip(line, line[2:], strict=False):
        size = math.hypot(bx - ax, by - ay)
        tangents.append(((bx - ax) / size, (by - ay) / size) if size else None)
    tangents.append(None)
    out = []
    for k, (p, q) in enumerate(zip(line, line[1:], strict=False)):
        third = math.hypot(q[0] - p[0], q[1] - p[1]) / 3
        s, t = tangents[k], tangents[k + 1]
        c0 = (p[0] + s[0] * third, p[1] + s[1] * third) if s else (p[0] + (q[0] - p[0]) / 3, p[1] + (q[1] - p[1]) / 3)
        c1 = (q[0] - t[0] * third, q[1] - t[1] * third) if t else (q[0] - (q[0] - p[0]) / 3, q[1] - (q[1] - p[1]) / 3)
        out.append((p, c0, c1, q))
    return out


def flatten(line: list[Point], scale: float = 100.0) -> list[Point]:
    """The curve as a line, halved until a piece is within 1/scale of straight."""
    if len(line) < 3:
        return list(line)
    out = [line[0]]
    for piece in control_points(line):
        work = [(piece, 0)]
        while work:
            (a, b, c, d), level = work.pop()
            size = math.hypot(d[0] - a[0], d[1] - a[1]) or 1.0
            away = max(abs((x - a[0]) * (d[1] - a[1]) - (y - a[1]) * (d[0] - a[0])) / size for x, y in (b, c))
            if away <= 1 / scale or level == 12:
                out.append(d)
                continue
            half = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
            ab, bc, cd = half(a, b), half(b, c), half(c, d)
            abc, bcd = half(ab, bc), half(bc, cd)
            m = half(abc, bcd)
            work += [((m, bcd, cd, d), level + 1), ((a, ab, abc, m), level + 1)]
    return out
