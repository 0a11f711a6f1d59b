"""Keyed random draws: a value depends on (tag, key) only, so results don't
depend on partitioning and any engine with md5 can repeat them.

A stream is a prefix of tags, made of a world's seed and of the place where
something is drawn, such as a task of a recipe. Draws of different streams are
independent; the empty stream is that of no seed and no place."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def stream(seed: int | str | None, *places: object) -> str:
    """The stream of a seed and a place; places are steps, from the outside
    in, and no two different lists of them give one stream."""
    steps = ([] if seed is None else [f"seed={seed}"]) + [str(p) for p in places]
    return "".join(s.replace("%", "%25").replace("/", "%2F") + "/" for s in steps)


def draw(*key: object) -> float:
    """``uniform`` on the driver: the same value for the same tag and key."""
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) / 4294967296


def whole(low: int, high: int, *key: object) -> int:
    """A whole number from ``low`` to ``high``, both included."""
    return low + math.floor(draw(*key) * (high - low + 1))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uniform(tag: str, key: Column | str) -> Column:
    """Uniform in [0, 1) from the first 32 bits of md5(tag:key)."""
    digest = F.md5(F.concat(F.lit(f"{tag}:"), _col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def bernoulli(tag: str, key: Column | str, p: float | Column) -> Column:
    return uniform(tag, key) < (F.lit(p) if isinstance(p, float) else p)


def normal(tag: str, key: Column | str, mean: float | Column = 0.0, sd: float | Column = 1.0) -> Column:
    """Box-Muller from two uniforms."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    z = F.sqrt(-2.0 * F.log(1.0 - uniform(f"{tag}_a", key))) * F.cos(F.lit(6.283185307179586) * uniform(f"{tag}_b", key))
    return as_col(mean) + as_col(sd) * z


def between(tag: str, key: Column | str, low: float, high: float) -> Column:
    return F.lit(float(low)) + uniform(tag, key) * F.lit(float(high - low))
