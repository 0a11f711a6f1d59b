"""Colours by hue range and luminosity, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisframe.functions.rand import uniform
from orbisframe.operators.tables import number_rows

# Named colours as (lowest hue, highest hue, lower bounds of value by
# saturation as (saturation, value)); hues from 334 on count as negative.
HUES = {
    "Red": (-26.0, 18.0, ((0.20, 1.00), (0.30, 0.92), (0.40, 0.89), (0.50, 0.85), (0.60, 0.78), (0.70, 0.70), (0.80, 0.60), (0.90, 0.55), (1.00, 0.50))),
    "Orange": (18.0, 46.0, ((0.20, 1.00), (0.30, 0.93), (0.40, 0.88), (0.50, 0.86), (0.60, 0.85), (0.70, 0.70), (1.00, 0.70))),
    "Yellow": (46.0, 62.0, ((0.25, 1.00), (0.40, 0.94), (0.50, 0.89), (0.60, 0.86), (0.70, 0.84), (0.80, 0.82), (0.90, 0.80), (1.00, 0.75))),
    "Green": (62.0, 178.0, ((0.30, 1.00), (0.40, 0.90), (0.50, 0.85), (0.60, 0.81), (0.70, 0.74), (0.80, 0.64), (0.90, 0.50), (1.00, 0.40))),
    "Blue": (178.0, 257.0, ((0.20, 1.00), (0.30, 0.86), (0.40, 0.80), (0.50, 0.74), (0.60, 0.60), (0.70, 0.52), (0.80, 0.44), (0.90, 0.39), (1.00, 0.35))),
    "Purple": (257.0, 282.0, ((0.20, 1.00), (0.30, 0.87), (0.40, 0.79), (0.50, 0.70), (0.60, 0.65), (0.70, 0.59), (0.80, 0.52), (0.90, 0.45), (1.00, 0.42))),
    "Pink": (282.0, 334.0, ((0.20, 1.00), (0.30, 0.90), (0.40, 0.86), (0.60, 0.84), (0.80, 0.80), (0.90, 0.75), (1.00, 0.73))),
}

LUMINOSITIES = ("Bright", "Dark", "Light")


def _named(hue: Column) -> Column:
    """The first named colour whose range holds the hue, as a struct. The
    table is one folded constant, so the expression stays small."""
    num = lambda v: F.lit(float(v))
    table = [
        F.struct(
            num(low).alias("low"), num(high).alias("high"), num(bounds[0][0]).alias("least"), num(bounds[-1][0]).alias("most"),
            F.array(*[F.struct(num(s1).alias("s1"), num(s2).alias("s2"), num(v1).alias("v1"), num((v2 - v1) / (s2 - s1)).alias("slope")) for (s1, v1), (s2, v2) in zip(bounds, bounds[1:], strict=False)]).alias("steps"),
        )
        for low, high, bounds in HUES.values()
    ]
    h = F.pmod(hue, F.lit(360.0))
    h = F.when(h >= 334, h - 360).otherwise(h)
    return F.get(F.filter(F.array(*table), lambda x: (h >= x["low"]) & (h <= x["high"])), F.lit(0))


def least_value(hue: Column, saturation: Column) -> Column:
    """Lowest value of a colour with that hue and saturation; 0 outside the
    saturations that its named colour lists."""
    step = F.get(F.filter(_named(hue)["steps"], lambda x: (saturation >= x["s1"]) & (saturation <= x["s2"])), F.lit(0))
    return F.coalesce(step["v1"] + (saturation - step["s1"]) * step["slope"], F.lit(0.0))


def saturation_range(hue: Column, luminosity: str | None) -> tuple[Column, Column]:
    if luminosity is None:
        return F.lit(0.0), F.lit(1.0)
    low, high = _named(hue)["least"], _named(hue)["most"]
    return {"Bright": (F.lit(0.55), high), "Dark": (low - 0.10, high), "Light": (low, F.lit(0.55))}[luminosity]


def value_range(hue: Column, saturation: Column, luminosity: str | None) -> tuple[Column, Column]:
    low = least_value(hue, saturation)
    if luminosity == "Dark":
        return low, low + 0.20
    return ((low + 1.0) / 2 if luminosity == "Light" else low), F.lit(1.0)


def hex_color(hue: Column, saturation: Column, value: Column) -> Column:
    """#RRGGBB of a colour given by hue, saturation and value."""
    level = lambda k: F.pmod(F.lit(float(k)) + hue / 60, F.lit(6.0))
    part = lambda k: F.lpad(F.hex(F.round((value - value * saturation * F.greatest(F.lit(0.0), F.least(level(k), 4 - level(k), F.lit(1.0)))) * 255).cast("int")), 2, "0")
    return F.concat(F.lit("#"), part(5), part(3), part(1))


def hue_of(color: Column) -> Column:
    """Hue of #RRGGBB, 0 for grey."""
    part = lambda at: F.conv(F.substring(color, at, 2), 16, 10).cast("double")
    r, g, b = part(2), part(4), part(6)
    top, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    turn = F.when(span == 0, 0.0).when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return turn * 60.0


def random_colors(rows: DataFrame, hue_low: float = 0.0, hue_high: float = 360.0, luminosity: str | None = "Light", stream: str = "") -> DataFrame:
    """``rows`` (with fid) and ``color``: the hue range in as many equal parts
    as rows, dealt in a keyed order, a random hue in each, saturation and value
    drawn inside the bounds that hue and luminosity set."""
    n = rows.agg(F.count("*").alias("_all"))
    dealt = number_rows(rows.withColumn("_u", uniform(f"{stream}deal", "fid")), ["_u", "fid"], "_place", 0)
    hue = F.lit(hue_low) + (F.col("_place") + uniform(f"{stream}hue", "fid")) * (hue_high - hue_low) / F.col("_all")
    return color_by_hue(dealt.crossJoin(F.broadcast(n)).withColumn("_h", hue), luminosity, stream).drop("_all", "_u", "_place")


def color_by_hue(rows: DataFrame, luminosity: str | None, stream: str = "") -> DataFrame:
    """``color`` for rows with fid and a hue ``_h``."""
    low, high = saturation_range(F.col("_h"), luminosity)
    rows = rows.withColumn("_s", low + uniform(f"{stream}sat", "fid") * (high - low))
    low, high = value_range(F.col("_h"), F.col("_s"), luminosity)
    rows = rows.withColumn("_v", low + uniform(f"{stream}val", "fid") * (high - low))
    return rows.withColumn("color", hex_color(F.col("_h"), F.col("_s"), F.col("_v"))).drop("_h", "_s", "_v")


def hue_subranges(rows: DataFrame, count: int, low: float = 0.0, high: float = 360.0) -> DataFrame:
    """``rows`` (with color) and the part of the hue range, cut into ``count``
    equal parts, that the colour's hue lies in; outside of all it is the hue
    alone."""
    step = (high - low) / count
    h = hue_of(F.col("color"))
    k = F.floor((h - low) / step)
    inside = (h >= low) & (h < high)
    return rows.withColumn("hue_low", F.when(inside, low + k * step).otherwise(h)).withColumn("hue_high", F.when(inside, low + (k + 1) * step).otherwise(h))


def subnation_colors(subnations: DataFrame, nations: DataFrame, stream: str = "") -> DataFrame:
    """(fid, color): colours of subnations inside the part of the hue circle
    that their nation's colour came from, one part of that each. Nations are
    fid and color; both are joined by id, counted by group."""
    from pyspark.sql import Window

    n = nations.select(F.col("fid").alias("nation_id"), "color").join(subnations.groupBy("nation_id").agg(F.count("*").alias("_n")), "nation_id")
    ranged = hue_subranges(n, max(1, nations.count())).drop("color")
    k = F.row_number().over(Window.partitionBy("nation_id").orderBy(uniform(f"{stream}sub_deal", "fid"), "fid")) - 1
    j = subnations.select("fid", "nation_id").withColumn("_k", k).join(ranged, "nation_id")
    hue = F.col("hue_low") + (F.col("_k") + uniform(f"{stream}hue", "fid")) * (F.col("hue_high") - F.col("hue_low")) / F.col("_n")
    return color_by_hue(j.withColumn("_h", hue), "Light", stream).select("fid", "color")
