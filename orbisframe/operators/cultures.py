"""Founding cultures: choosing sets, ranking tiles by preference, spacing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisframe.functions.rand import draw, uniform
from orbisframe.operators.people import culture_type, expansionism, preference
from orbisframe.operators.settle import name_duplicates
from orbisframe.operators.tables import number_rows
from orbisframe.session import cut

#: Draws after which a place is taken even if it is too close to another.
ATTEMPTS = 100
#: Draws, over all places, after which a set is taken whatever its probability.
PATIENCE = 200


def weighted_reject_sample(items: list[tuple[object, float]], count: int, stream: str = "") -> list[object]:
    """Up to ``count`` of the items (a configuration's list) without
    replacement: one is drawn evenly and kept with its probability, else
    another is drawn; after 200 draws in all, whatever is drawn is kept."""
    left, out, draws = list(items), [], 0
    while left and len(out) < count:
        draws += 1
        k = int(draw(f"{stream}culture_set_pick", draws) * len(left))
        if draws >= PATIENCE or draw(f"{stream}culture_set_keep", draws) < left[k][1]:
            out.append(left.pop(k)[0])
    return out


def sort_preference(tiles: DataFrame, tree: dict | str | float, max_habitability: float = 1.0, highest_first: bool = False) -> DataFrame:
    """``tiles`` with ``preference`` and their ``place`` in its order, from 0;
    equal ones by fid. A range sort, so no task holds all tiles."""
    scored = tiles.withColumn("preference", preference(tree, max_habitability).cast("double"))
    scored = scored.withColumn("_o", -F.col("preference") if highest_first else F.col("preference"))
    return number_rows(scored, ["_o", "fid"], "place", 0).drop("_o")


def biased_choice(tag: str, key: Column | str, low: int, high: int, bias: float = 5.0, compat: bool = False) -> Column:
    """A random index in [low, high), the lower the likelier; ``compat``
    always gives the lowest."""
    return F.lit(low) if compat else (F.lit(low) + F.floor(F.pow(uniform(tag, key), float(bias)) * (high - low))).cast("int")


def too_close(points: DataFrame, placed: list[tuple[float, float]], spacing: float) -> DataFrame:
    """``points`` (x, y) with ``too_close``: whether one of the placed points,
    a list as long as the configuration's cultures, is nearer than ``spacing``."""
    near = F.lit(False)
    for x, y in placed:
        near = near | ((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) < spacing * spacing)
    return points.withColumn("too_close", near)


def generate_cultures(
    tiles: DataFrame, sources: list[dict], count: int, width: float = 360.0, height: float = 180.0, variance: float = 1.0, river_threshold: float = 10.0, compat: bool = False, stream: str = ""
) -> tuple[DataFrame, list[str]]:
    """(cultures, warnings). ``tiles``: the columns that preferences and
    culture types read, with site_x, site_y, habitability and population;
    ``sources``: name, namer, probability, preferences.

    Each culture ranks the populated tiles that are left by its preference and
    draws places among the better half, the best likeliest, until one is far
    enough from the centres so far; the distance asked for shrinks with every
    draw. Its draws are keyed, so they are known beforehand: the ranked tiles
    are filtered to those places, at most a hundred rows, before the driver
    sees them. ``compat`` ranks from the lowest preference and always takes
    the first."""
    warnings = []
    if count > len(sources):
        warnings.append(f"the culture set is not large enough, the count is limited to {len(sources)}")
    people = cut(tiles.where("population > 0"))
    n, top = people.agg(F.count("*"), F.max("habitability")).first()
    count = min(count, len(sources))
    if n < count * 25:
        count = n // 25
        warnings.append(f"there aren't enough habitable tiles, the count is limited to {count}")
    spacing = (width + height) / 2 / count if count else 0.0
    chosen, half = [], max(n // 2, 1)
    for k, source in enumerate(weighted_reject_sample([(s, float(s.get("probability") or 1)) for s in sources], count, stream)):
        gone = [c["center_tile_id"] for c in chosen]
        ranked = sort_preference(people.where(~F.col("fid").isin(gone)) if gone else people, source.get("preferences") or "Habitability", top or 1.0, not compat)
        places = [0] * (ATTEMPTS + 2) if compat else [int(draw(f"{stream}center", f"{k}_{i}") ** 5 * half) for i in range(ATTEMPTS + 2)]
        found = {r.place: r for r in ranked.where(F.col("place").isin(sorted(set(places)))).select("place", "fid", "site_x", "site_y").collect()}
        for i, place in enumerate(places):
            r = found[place]
            near = any(math.hypot(c["x"] - r.site_x, c["y"] - r.site_y) < spacing * 0.9**i for c in chosen)
            if i > ATTEMPTS or not near:
                chosen.append({"fid": k + 1, "name": source.get("name"), "namer": source.get("namer"), "center_tile_id": r.fid, "x": r.site_x, "y": r.site_y})
                break
    rows = tiles.sparkSession.createDataFrame(
        [(c["fid"], c["name"], c["namer"], c["center_tile_id"]) for c in chosen], "fid long, name string, namer string, center_tile_id long"
    )
    center = people.withColumn("_type", culture_type(river_threshold, stream=stream)).select(F.col("fid").alias("center_tile_id"), F.col("_type").alias("type_"))
    out = name_duplicates(rows).join(center, "center_tile_id")
    return out.select("fid", "name", "namer", "type_", expansionism(F.col("type_"), "fid", variance, stream).alias("expansionism"), "center_tile_id"), warnings
