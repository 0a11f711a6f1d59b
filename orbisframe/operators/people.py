"""Population, culture preference, culture types, expansion over the map."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisframe.functions.near import Near
from orbisframe.functions.rand import uniform

# Suitability by the type of a lake at the harbour.
LAKE_BONUS = {"Fresh": 30.0, "Salt": 10.0, "Frozen": 1.0, "Pluvial": -2.0, "Dry": -5.0, "Marsh": 5.0}
# Expansionism by culture type.
EXPANSION_BASE = {"Lake": 0.8, "Naval": 1.5, "Nomadic": 1.5, "River": 0.9, "Hunting": 0.7, "Highland": 1.2, "Generic": 1.0}
# Biomes that hinder nomads.
FORESTS = ("Tropical Seasonal Forest", "Temperate Deciduous Forest", "Tropical Rainforest", "Temperate Rainforest", "Taiga")


def lookup(c: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def flow_totals(tiles: DataFrame) -> DataFrame:
    """One row: mean and largest flow, mean area, and the flow divisor."""
    t = tiles.agg(F.sum("water_flow").alias("s"), F.max("water_flow").alias("flow_max"), F.sum("area").alias("a"), F.count("*").alias("n"))
    return t.select((F.col("s") / F.col("n")).alias("flow_mean"), "flow_max", (F.col("a") / F.col("n")).alias("area_mean"), (F.col("flow_max") - F.col("s") / F.col("n")).alias("flow_divisor"))


def population(tiles: DataFrame, biomes: DataFrame, lakes: DataFrame, river_threshold: float = 10.0, grouping: str = "grouping") -> DataFrame:
    """Tiles with habitability and population. Where all flows are equal the
    flow bonus is 0. The scalar totals are one broadcast row."""
    harbor = tiles.select(F.col("fid").alias("_h"), F.col("lake_id").alias("_hl"), F.col(grouping).alias("_hg"))
    kinds = lakes.select(F.col("fid").alias("_lf"), F.col("type_").alias("_lt"))
    live = biomes.select(F.col("name").alias("_bn"), F.col("habitability").cast("double").alias("_bh"))
    t = tiles.drop("habitability", "population").join(F.broadcast(live), tiles["biome"] == F.col("_bn"), "left")
    t = t.join(harbor.join(kinds, F.col("_hl") == F.col("_lf"), "left"), F.col("harbor_tile_id") == F.col("_h"), "left").crossJoin(F.broadcast(flow_totals(tiles)))
    base = F.when(F.col("lake_id").isNotNull(), 0.0).otherwise(F.col("_bh"))
    ratio = (F.col("water_flow") - F.col("flow_mean")) / F.when(F.col("flow_divisor") > 0, F.col("flow_divisor"))
    s = base + F.when(F.col("flow_mean") > 0, F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)), F.lit(0.0)) * 250.0).otherwise(0.0)
    s = s - (F.col("elevation_scaled") - 50).cast("double") / 5.0
    sea = F.when(F.col("_hg") == "Ocean", 5.0 + F.when(F.col("water_count") == 1, 20.0).otherwise(0.0)).otherwise(0.0)
    at_harbor = F.when(F.col("_h").isNull(), 0.0).when(F.col("_lt").isNotNull(), lookup(F.col("_lt"), LAKE_BONUS, 0.0)).otherwise(sea)
    coast = F.when(F.col("shore_distance") == 1, F.when(F.col("water_flow") > river_threshold, 15.0).otherwise(0.0) + at_harbor).otherwise(0.0)
    hab = F.when(base > 0, (s + coast) / 5.0).otherwise(0.0)
    out = t.withColumn("habitability", hab)
    out = out.withColumn("population", F.when(base > 0, F.floor(F.col("habitability") * F.col("area") / F.col("area_mean") * 1000.0)).otherwise(0).cast("int"))
    return out.drop("_bn", "_bh", "_h", "_hl", "_hg", "_lf", "_lt", "flow_mean", "flow_max", "area_mean", "flow_divisor")


def preference(tree: dict | str | float, max_habitability: Column | float = 1.0) -> Column:
    """A culture's preference, a tree of named terms, as one Column."""
    if isinstance(tree, int | float):
        return F.lit(float(tree))
    if isinstance(tree, str):
        tree = {tree: None}
    ((kind, arg),) = tree.items()
    sub = lambda x: preference(x, max_habitability)
    top = max_habitability if isinstance(max_habitability, Column) else F.lit(float(max_habitability))
    match kind:
        case "Habitability":
            return F.col("habitability")
        case "ShoreDistance":
            return F.col("shore_distance").cast("double")
        case "Elevation":
            return F.col("elevation_scaled").cast("double")
        case "NormalizedHabitability":
            return F.ceil(F.col("habitability") / top * 3)
        case "Temperature":
            return F.abs(F.col("temperature") - float(arg)) + 1
        case "Biomes":
            return F.when(F.col("biome").isin(arg[0]), 1.0).otherwise(float(arg[1]))
        case "OceanCoast":
            return F.when(F.col("water_count").isNotNull() & F.coalesce(F.col("neighboring_lake_size"), F.lit(0)).eqNullSafe(0), 1.0).otherwise(float(arg))
        case "Negate":
            return -sub(arg)
        case "Multiply":
            return sub(arg[0]) * sub(arg[1])
        case "Divide":
            return sub(arg[0]) / sub(arg[1])
        case "Add":
            return sub(arg[0]) + sub(arg[1])
        case "Pow":
            return F.pow(sub(arg[0]), float(arg[1]))
    raise ValueError(f"unknown preference {kind}")


def culture_type(river_threshold: float = 10.0, key: str = "fid", stream: str = "") -> Column:
    """Type of a culture centred on the tile: a decision list whose chances
    are drawn by the tile's key."""
    lake = F.col("neighboring_lake_size")
    naval = (lake.isNull() & (uniform(f"{stream}ct_sea", key) < 0.1)) | ((F.col("water_count") == 1) & (uniform(f"{stream}ct_bay", key) < 0.6)) | ((F.col("grouping") == "Islet") & (uniform(f"{stream}ct_islet", key) < 0.4))
    return (
        F.when((F.col("elevation_scaled") < 70) & F.col("supports_nomadic"), "Nomadic").when(F.col("elevation_scaled") > 50, "Highland")
        .when(F.col("water_count").isNotNull() & (F.coalesce(lake, F.lit(0)) > 5), "Lake").when(F.col("water_count").isNotNull() & naval, "Naval")
        .when(F.col("water_flow") > river_threshold, "River").when((F.col("shore_distance") > 2) & F.col("supports_hunting"), "Hunting").otherwise("Generic")
    )


def expansionism(type_: Column, key: Column | str, variance: float = 1.0, stream: str = "") -> Column:
    return (uniform(f"{stream}expansion", key) * variance / 2.0 + 1.0) * lookup(type_, EXPANSION_BASE, 1.0)


def shore_cost(t: Column, d: Column) -> Column:
    """Cost of a neighbour by its shore distance; cultures and nations alike."""
    inland = F.when(d.isin(1, -1), 0.0)
    return (
        F.when(t == "Lake", F.when(d.isin(1, 2, -1), 0.0).otherwise(100.0)).when(t == "Naval", inland.when(d == 2, 30.0).otherwise(100.0))
        .when(t == "Nomadic", F.when(d == 1, 60.0).when(d == 2, 30.0).otherwise(0.0)).otherwise(F.when(d == 1, 20.0).otherwise(0.0))
    )


def river_cost(t: Column, flow: Column, threshold: float) -> Column:
    other = F.when(flow <= threshold, 0.0).otherwise(F.greatest(F.lit(20.0), F.least(F.lit(100.0), flow / 10.0)))
    return F.when(t == "River", F.when(flow > threshold, 0.0).otherwise(100.0)).otherwise(other)


def _slope(scaled: Column, high: float, hill: float) -> Column:
    return F.when(scaled >= 67, high).when(scaled > 44, hill).otherwise(0.0)


def height_cost(t: Column, water: Column, lake: Column, scaled: Column, area: Column) -> Column:
    """Culture expansion: crossing water by area, mountains and hills."""
    dry = _slope(scaled, 200.0, 30.0)
    high = F.when(water, area * 6.0).when(scaled < 44, 3000.0).when(scaled < 62, 200.0).otherwise(0.0)
    return (
        F.when(t == "Lake", F.when(lake.isNotNull(), 10.0).when(water, area * 6.0).otherwise(dry)).when(t == "Naval", F.when(water, area * 2.0).otherwise(dry))
        .when(t == "Nomadic", F.when(water, area * 50.0).otherwise(dry)).when(t == "Highland", high).otherwise(F.when(water, area * 6.0).otherwise(dry))
    )


def biome_cost(t: Column, home: Column, biome: Column, movement: Column) -> Column:
    away = F.when(t == "Hunting", movement * 5).when(t == "Nomadic", F.when(biome.isin(*FORESTS), movement * 10).otherwise(movement * 2)).otherwise(movement * 2)
    return F.when(home == biome, 10.0).otherwise(away.cast("double"))


def nation_height_cost(t: Column, ocean: Column, shore: Column, lake: Column, scaled: Column) -> Column:
    deep, dry = (shore < -1) | ocean, _slope(scaled, 2200.0, 300.0)
    return (
        F.when(t == "Lake", F.when(lake.isNotNull(), 10.0).when(deep, 1000.0).otherwise(dry)).when(t == "Naval", F.when(deep, 300.0).otherwise(dry))
        .when(t == "Highland", F.when(deep, 1000.0).when(scaled < 62, 1100.0).otherwise(0.0)).otherwise(F.when(deep, 1000.0).otherwise(dry))
    )


def nation_biome_cost(t: Column, home: Column, biome: Column, movement: Column) -> Column:
    away = F.when(t == "Hunting", movement * 2).when(t == "Nomadic", F.when(biome.isin(*FORESTS), movement * 3).otherwise(movement)).otherwise(movement)
    return F.when(home == biome, 10.0).otherwise(away.cast("double"))


def spread(near: dict[int, list[int]] | Near, seeds: list[tuple[int, int]], limit: float, cost: Callable[[int, int, int], float | None], n_tiles: int | None = None) -> tuple:
    """Owner and cost of each tile reached from the seeds (owner, center).
    ``cost(owner, from, to)`` is that of a step, None where it can't be taken.
    One queue serves all owners: an entry that was replaced by a cheaper owner
    still spreads, seeds are never taken, and equal costs go to the smaller
    (fid, owner). With ``n_tiles``, tiles are numbered from 0 to it, and arrays
    are returned, with infinite cost where no owner comes."""
    held = {c for _, c in seeds}
    flat = n_tiles is not None
    owner, best, queue = (np.zeros(n_tiles, np.int64), np.full(n_tiles, math.inf), []) if flat else ({}, {}, [])
    for o, c in sorted(seeds):
        owner[c], best[c] = o, 1.0
        queue.append((0.0, c, o))
    heapq.heapify(queue)
    while queue:
        so_far, f, o = heapq.heappop(queue)
        for n in near[f] if flat else near.get(f, ()):
            c = None if n in held else cost(o, f, n)
            if c is None:
                continue
            total = so_far + c
            if total <= limit and total < (best[n] if flat else best.get(n, math.inf)):
                owner[n], best[n] = o, total
                heapq.heappush(queue, (total, n, o))
    return owner, best


def _near(pdf: pd.DataFrame) -> dict[int, list[int]]:
    return {f: list(n) for f, n in zip(pdf["fid"].tolist(), pdf["near"], strict=True) if isinstance(n, np.ndarray | list)}


def _with_near(rows: DataFrame, edges: DataFrame) -> DataFrame:
    near = edges.where("dst is not null").groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("near"))
    return rows.join(near, F.col("fid") == F.col("src"), "left").drop("src")


def expand(entries: DataFrame, edges: DataFrame, seeds: DataFrame, limit: float, world: str | None = None) -> DataFrame:
    """Least-cost expansion from seeds (owner, center).

    ``entries`` has one row (owner, fid, cost) per owner and tile that the
    owner may enter. Worlds, or regions that owners don't leave, are
    independent groups, named by a column of both tables; within one, the
    queue of ``spread`` runs over all owners."""
    one = [F.lit(0).alias("_w")] if world is None else [F.col(world).alias("_w")]
    left = _with_near(entries.select(*one, "owner", "fid", "cost"), edges)
    right = seeds.select(*one, F.col("owner").alias("s_owner"), F.col("center"))

    def work(pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        cost = {(o, f): c for o, f, c in zip(pdf["owner"].tolist(), pdf["fid"].tolist(), pdf["cost"].tolist(), strict=True)}
        owner, best = spread(_near(pdf), list(zip(starts["s_owner"].tolist(), starts["center"].tolist(), strict=True)), limit, lambda o, f, n: cost.get((o, n)))
        return pd.DataFrame({"fid": list(owner), "owner": list(owner.values()), "cost": [best[f] for f in owner]})

    return left.groupBy("_w").cogroup(right.groupBy("_w")).applyInPandas(lambda a, b: work(a, b), "fid long, owner long, cost double")


def _expand_by_type(tiles: DataFrame, edges: DataFrame, owners: DataFrame, limit: float, base: Callable[[str], Column], away: Callable[[str], Column], nations: bool, biomes: DataFrame) -> DataFrame:
    """Expansion whose costs depend on the owner's type and home biome only:
    one row a tile, with the costs of each type as an array, however many
    owners there are; the cost of a step is put together when it is taken."""
    by_type = lambda f: F.array(*[f(t).cast("double") for t in EXPANSION_BASE])
    rows = tiles.select(F.lit(0).alias("_w"), F.col("fid").cast("long").alias("fid"), "biome", F.col("area").cast("double").alias("area"), F.col("culture_key" if nations else "fid").cast("long").alias("people"), by_type(base).alias("base"))
    rows = _with_near(rows, edges.withColumn("dst", F.col("dst").cast("long")))
    home = tiles.select(F.col("fid").alias("center_tile_id"), F.col("biome").alias("home"))
    starts = owners.join(home, "center_tile_id").select(F.lit(0).alias("_w"), "owner", "center_tile_id", "type_", "expansionism", "home")
    kinds = list(EXPANSION_BASE)
    # what a biome costs is the same for all its tiles, and biomes are configuration
    elsewhere = {r.biome: list(r.away) for r in biomes.select(F.col("name").alias("biome"), "movement_cost").select("biome", by_type(away).alias("away")).collect()}

    def work(table: pa.Table, starts: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"fid": pa.array([], "int64"), "owner": pa.array([], "int64"), "cost": pa.array([], "float64")})
        fid = np.asarray(table.column("fid"))
        order, near = Near.of(fid, table.column("near"))
        fid, area = fid[order], np.asarray(table.column("area"))[order]
        people = np.asarray(table.column("people").fill_null(np.iinfo(np.int64).min))[order]
        names = table.column("biome").combine_chunks().dictionary_encode()
        biome, names = np.asarray(names.indices)[order], names.dictionary.to_pylist()
        base = np.concatenate([np.asarray(c.flatten()) for c in table.column("base").chunks]).reshape(len(fid), len(kinds))
        del table
        away = [elsewhere[x] for x in names]
        who = {o: (kinds.index(t) if t in kinds else kinds.index("Generic"), x, h) for o, t, x, h in zip(*(starts.column(c).to_pylist() for c in ("owner", "type_", "expansionism", "home")), strict=True)}

        def cost(o: int, f: int, n: int) -> float:
            k, x, own = who[o]
            b = biome[n]
            c = float(base[order[n], k]) + (10.0 if names[b] == own else away[b][k])
            if nations:
                return max(0.0, c + (-9.0 if people[f] == people[n] else 100.0)) * float(area[n]) / x + 10.0
            return c / x

        seeds = list(zip(starts.column("owner").to_pylist(), np.searchsorted(fid, np.asarray(starts.column("center_tile_id"))).tolist(), strict=True))
        owner, best = spread(near, seeds, limit, cost, len(fid))
        reached = np.flatnonzero(best < math.inf)
        return pa.table({"fid": fid[reached], "owner": owner[reached], "cost": best[reached]})

    return rows.groupBy("_w").cogroup(starts.groupBy("_w")).applyInArrow(lambda a, b: work(a, b), "fid long, owner long, cost double")


def expand_cultures(tiles: DataFrame, edges: DataFrame, cultures: DataFrame, biomes: DataFrame, limit: float, river_threshold: float = 10.0, grouping: str = "grouping") -> DataFrame:
    """(fid, owner, cost): the culture (its culture_key) that reaches each tile first."""
    t = tiles.join(F.broadcast(biomes.select(F.col("name").alias("biome"), "movement_cost")), "biome")
    wet, c = F.col(grouping).isin("Ocean", "Lake"), F.col

    def base(kind: str) -> Column:
        k = F.lit(kind)
        return height_cost(k, wet, c("lake_id"), c("elevation_scaled"), c("area")) + river_cost(k, c("water_flow"), river_threshold) + shore_cost(k, c("shore_distance"))

    away = lambda kind: biome_cost(F.lit(kind), F.lit(None).cast("string"), c("biome"), c("movement_cost"))
    return _expand_by_type(t, edges, cultures.withColumn("owner", c("culture_key").cast("long")), limit, base, away, False, biomes)


def expand_nations(tiles: DataFrame, edges: DataFrame, nations: DataFrame, biomes: DataFrame, limit: float, river_threshold: float = 10.0, grouping: str = "grouping") -> DataFrame:
    """(fid, owner, cost): the nation that reaches each tile first. A step into
    a tile of another culture than that of the tile before costs more."""
    t = tiles.join(F.broadcast(biomes.select(F.col("name").alias("biome"), "movement_cost")), "biome")
    c = F.col
    settled = F.when(c(grouping).isin("Ocean", "Lake"), 0.0).when(c("habitability") > 0, F.greatest(F.lit(0.0), 20.0 - c("habitability"))).otherwise(5000.0)

    def base(kind: str) -> Column:
        k = F.lit(kind)
        return settled + nation_height_cost(k, c(grouping) == "Ocean", c("shore_distance"), c("lake_id"), c("elevation_scaled")) + river_cost(k, c("water_flow"), river_threshold) + shore_cost(k, c("shore_distance"))

    away = lambda kind: nation_biome_cost(F.lit(kind), F.lit(None).cast("string"), c("biome"), c("movement_cost"))
    return _expand_by_type(t, edges, nations.withColumn("owner", c("fid")), limit, base, away, True, biomes)


def _dealt(tiles: DataFrame, *columns: str) -> DataFrame:
    """The columns of tiles that pairs need, in a few parts for each core: a
    small table makes many pairs, which its own size doesn't tell."""
    parts = 4 * tiles.sparkSession.sparkContext.defaultParallelism
    return tiles.select("fid", "biome", "movement_cost", *columns).repartition(parts, "fid")


def culture_entries(tiles: DataFrame, cultures: DataFrame, biomes: DataFrame, river_threshold: float = 10.0, grouping: str = "grouping") -> DataFrame:
    """(owner, fid, cost) of every tile for every culture; the culture table is
    small by configuration (tens), so it is the broadcast side. Tiles are dealt
    over all cores first, however few files they come from."""
    home = tiles.select(F.col("fid").alias("center_tile_id"), F.col("biome").alias("home"))
    c = cultures.join(home, "center_tile_id").select(F.col("culture_key").alias("owner"), F.col("type_").alias("t"), F.col("expansionism").alias("x"), "home")
    t = tiles.join(F.broadcast(biomes.select(F.col("name").alias("biome"), "movement_cost")), "biome")
    t = _dealt(t, "area", "lake_id", "elevation_scaled", "water_flow", "shore_distance", grouping).crossJoin(F.broadcast(c))
    water = F.col(grouping).isin("Ocean", "Lake")
    cost = biome_cost(F.col("t"), F.col("home"), F.col("biome"), F.col("movement_cost")) + height_cost(F.col("t"), water, F.col("lake_id"), F.col("elevation_scaled"), F.col("area"))
    cost = cost + river_cost(F.col("t"), F.col("water_flow"), river_threshold) + shore_cost(F.col("t"), F.col("shore_distance"))
    return t.select("owner", "fid", (cost / F.col("x")).alias("cost"))


def nation_entries(tiles: DataFrame, nations: DataFrame, biomes: DataFrame, river_threshold: float = 10.0, grouping: str = "grouping") -> DataFrame:
    """(owner, fid, cost) of entering each tile from the nation's own culture:
    a table of costs for each pair, for looking at; ``expand_nations`` doesn't
    need it, and takes the cultures of a step's two tiles."""
    home = tiles.select(F.col("fid").alias("center_tile_id"), F.col("biome").alias("home"))
    n = nations.join(home, "center_tile_id").select(F.col("fid").alias("owner"), F.col("type_").alias("t"), F.col("expansionism").alias("x"), F.col("culture_key").alias("own"), "home")
    t = tiles.join(F.broadcast(biomes.select(F.col("name").alias("biome"), "movement_cost")), "biome")
    t = _dealt(t, "area", "lake_id", "elevation_scaled", "water_flow", "shore_distance", "habitability", "culture_key", grouping).crossJoin(F.broadcast(n))
    people = F.when(F.col(grouping).isin("Ocean", "Lake"), 0.0).when(F.col("habitability") > 0, F.greatest(F.lit(0.0), 20.0 - F.col("habitability"))).otherwise(5000.0)
    cost = F.when(F.col("own").eqNullSafe(F.col("culture_key")), -9.0).otherwise(100.0) + people
    cost = cost + nation_biome_cost(F.col("t"), F.col("home"), F.col("biome"), F.col("movement_cost"))
    cost = cost + nation_height_cost(F.col("t"), F.col(grouping) == "Ocean", F.col("shore_distance"), F.col("lake_id"), F.col("elevation_scaled"))
    cost = cost + river_cost(F.col("t"), F.col("water_flow"), river_threshold) + shore_cost(F.col("t"), F.col("shore_distance"))
    return t.select("owner", "fid", (F.greatest(F.lit(0.0), cost) * F.col("area") / F.col("x") + 10.0).alias("cost"))


def subnation_cost(elevation_scaled: Column, area: Column, shore: Column) -> Column:
    """Cost of a tile inside its nation; null where it can't be entered."""
    return F.when(shore >= -3, F.when(elevation_scaled >= 70, 100.0).when(elevation_scaled >= 50, 30.0).otherwise(10.0) * area)
