"""Towns, nations and subnations: scores, ranking, ports, normalisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbisframe.functions.rand import normal, uniform
from orbisframe.session import cut


def score_tiles(tiles: DataFrame, stream: str = "") -> DataFrame:
    """Tiles that can hold a town, with a score for capitals (habitability by
    a factor of one half to one) and one for towns (by a clamped normal)."""
    factor = F.greatest(F.lit(0.0), F.least(F.lit(20.0), normal(f"{stream}town_t", "fid", 1.0, 3.0)))
    return tiles.where("habitability > 0").select("*", (F.col("habitability") * (uniform(f"{stream}town_c", "fid") * 0.5 + 0.5)).alias("capital_score"), (F.col("habitability") * factor).alias("town_score"))


def capitals_topk(scored: DataFrame, count: int) -> DataFrame:
    """The best ``count`` tiles by capital score, then fid: one top-k, no sort of the whole."""
    return scored.orderBy(F.desc("capital_score"), "fid").limit(count)


def towns_topk(scored: DataFrame, capitals: DataFrame, count: int) -> DataFrame:
    return scored.join(capitals.select("fid"), "fid", "left_anti").orderBy(F.desc("town_score"), "fid").limit(count)


def town_counts(extent_area: float, populated: int, capitals: int | None = None, towns: int | None = None) -> tuple[int, int]:
    n = min(capitals if capitals is not None else int(extent_area / 1000), populated)
    return n, min(towns if towns is not None else int(extent_area / 100), populated - n)


def generate_towns(tiles: DataFrame, n_capitals: int, n_towns: int, stream: str = "") -> DataFrame:
    """(tile_id, is_capital, fid): capitals first, each in the order of its score."""
    scored = score_tiles(tiles, stream)
    cap = capitals_topk(scored, n_capitals)
    rows = cap.select("fid", F.lit(True).alias("is_capital"), F.col("capital_score").alias("score")).unionByName(towns_topk(scored, cap, n_towns).select("fid", F.lit(False).alias("is_capital"), F.col("town_score").alias("score")))
    # the number of towns is bounded by the two limits above
    order = Window.orderBy(F.desc("is_capital"), F.desc("score"), "fid")
    return rows.select(F.col("fid").alias("tile_id"), "is_capital", F.row_number().over(order).cast("long").alias("fid"))


def populate_towns(towns: DataFrame, tiles: DataFrame, lakes: DataFrame, river_threshold: float = 10.0, grouping: str = "grouping") -> DataFrame:
    """(fid, population, is_port, x, y): ports by harbour, population by
    habitability, rivers shift a town that is no port. A port that is alone on
    its water body isn't one, but keeps the population."""
    t = tiles.select(F.col("fid").alias("tile_id"), "habitability", "water_flow", "water_count", "harbor_tile_id", "site_x", "site_y")
    h = tiles.select(F.col("fid").alias("_h"), F.col("lake_id").alias("_hl"), F.col(grouping).alias("_hg"), F.col("temperature").alias("_ht"), F.col("grouping_id").alias("_hid"))
    s = lakes.select(F.col("fid").alias("_lf"), F.col("size").alias("_size"))
    j = towns.select("fid", "tile_id", "is_capital").join(t, "tile_id").join(h, F.col("harbor_tile_id") == F.col("_h"), "left").join(s, F.col("_hl") == F.col("_lf"), "left")
    large = F.when(F.col("_hl").isNotNull(), F.coalesce(F.col("_size") > 1, F.lit(False))).otherwise(F.col("_hg") == "Ocean")
    port = F.coalesce((F.col("_ht") > 0) & large & (F.col("is_capital") | F.coalesce(F.col("water_count") == 1, F.lit(False))), F.lit(False))
    j = j.withColumn("_port", port)
    pop = F.greatest(F.col("habitability") / 2.0 * 1000.0, F.lit(100.0)) * F.when(F.col("is_capital"), 1.3).otherwise(1.0) * F.when(F.col("_port"), 1.3).otherwise(1.0)
    shift = F.when(~F.col("_port") & (F.col("water_flow") > river_threshold), F.least(F.col("water_flow") / 150.0, F.lit(1.0))).otherwise(0.0)
    move = lambda c: F.when(F.col(c) % 2.0 < 1.0, F.col(c) + shift).otherwise(F.col(c) - shift)
    # counted apart: all towns of an ocean are on one body
    j = cut(j)
    body = j.where("_h is not null").groupBy(F.col("_hid").alias("_body")).agg(F.count("*").alias("_on"))
    j = j.join(body, F.col("_hid").eqNullSafe(F.col("_body")) & F.col("_h").isNotNull(), "left")
    alone = F.col("_h").isNotNull() & (F.col("_on") == 1)
    return j.select("fid", F.floor(pop).cast("int").alias("population"), (F.col("_port") & ~alone).alias("is_port"), move("site_x").alias("x"), move("site_y").alias("y"))


def generate_nations(towns: DataFrame, cultures: DataFrame, variance: float = 1.0, stream: str = "") -> DataFrame:
    """One nation a capital: type of its culture or Generic."""
    c = cultures.select(F.col("culture_key").alias("_c"), F.col("type_").alias("_t"))
    rows = towns.where("is_capital").join(F.broadcast(c), F.col("culture_key") == F.col("_c"), "left")
    order = Window.orderBy("fid")  # capitals are a bounded top-k
    return rows.select(
        F.row_number().over(order).cast("long").alias("fid"), F.col("fid").alias("capital_town_id"), "culture_key", F.col("tile_id").alias("center_tile_id"),
        F.coalesce("_t", F.lit("Generic")).alias("type_"), (1.0 + (uniform(f"{stream}nation_x", "fid") * 0.9 + 0.1) * variance).alias("expansionism"),
    )


def neighbor_counts(tiles: DataFrame, edges: DataFrame, owner: str, is_land: Column, within: str | None = None) -> DataFrame:
    """(src, buddies, adversaries, kinds, top, top_count) over land neighbours;
    null owners count as one kind. Equal counts go to null first, then the
    smallest owner. ``within`` restricts to neighbours of equal value."""
    cols = [owner] + ([within] if within else [])
    mine = tiles.where(is_land).select(F.col("fid").alias("src"), F.col(owner).alias("_own"), *([F.col(within).alias("_in")] if within else []))
    theirs = tiles.where(is_land).select(F.col("fid").alias("dst"), *[F.col(c).alias(f"n_{c}") for c in cols])
    near = edges.select("src", "dst").join(theirs, "dst").join(mine, "src")
    if within:
        near = near.where(F.col("_in").eqNullSafe(F.col(f"n_{within}")))
    kinds = near.groupBy("src", "_own", F.col(f"n_{owner}").alias("o")).agg(F.count("*").alias("n"))
    other = ~F.col("o").eqNullSafe(F.col("_own"))
    best = F.min(F.when(other, F.struct((-F.col("n")).alias("n"), F.col("o"))))
    return kinds.groupBy("src").agg(
        F.coalesce(F.sum(F.when(~other, F.col("n"))), F.lit(0)).alias("buddies"), F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0)).alias("adversaries"),
        F.count(F.when(other, F.lit(1))).alias("kinds"), best.alias("b"),
    ).select("src", "buddies", "adversaries", "kinds", F.col("b.o").alias("top"), (-F.col("b.n")).alias("top_count"))


def normalize(tiles: DataFrame, edges: DataFrame, owner: str, is_land: Column, fixed: DataFrame, near_fixed: DataFrame, within: str | None = None) -> DataFrame:
    """Tiles with their owner smoothed, all at once from a snapshot: a land tile
    without a town and not beside a protected one goes over to the strongest
    adversary if it has two adversaries at least, two buddies at most, as many
    kinds of adversaries as buddies, and that adversary outnumbers the buddies.

    ``fixed``: fids that keep their owner; ``near_fixed``: fids whose
    neighbours keep theirs too."""
    c = neighbor_counts(tiles, edges, owner, is_land, within)
    beside = edges.join(near_fixed.select(F.col("fid").alias("dst")), "dst").select(F.col("src").alias("fid")).union(fixed.select("fid")).distinct()
    change = c.where("adversaries >= 2 and buddies <= 2 and kinds >= buddies and top_count > buddies").select(F.col("src").alias("fid"), "top")
    change = change.join(beside, "fid", "left_anti").select(F.col("fid").alias("_c"), "top")
    out = tiles.join(change, tiles["fid"] == F.col("_c"), "left")
    return out.withColumn(owner, F.when(F.col("_c").isNotNull(), F.col("top")).otherwise(F.col(owner))).drop("_c", "top")


def normalize_nations(tiles: DataFrame, edges: DataFrame, towns: DataFrame, grouping: str = "grouping") -> DataFrame:
    capital = towns.where("is_capital").select(F.col("tile_id").alias("fid"))
    return normalize(tiles, edges, "nation_id", ~F.col(grouping).isin("Ocean", "Lake"), tiles.where("town_id is not null").select("fid"), capital)


def normalize_subnations(tiles: DataFrame, edges: DataFrame, seats: DataFrame, grouping: str = "grouping") -> DataFrame:
    """Within a nation; ``seats``: (fid) of tiles that hold a seat."""
    fixed = tiles.where("town_id is not null").select("fid").union(seats.select("fid")).distinct()
    return normalize(tiles, edges, "subnation_id", ~F.col(grouping).isin("Ocean", "Lake"), fixed, seats, "nation_id")


def subnation_seats(towns: DataFrame, percentage: float = 20.0, largest_first: bool = False, stream: str = "") -> DataFrame:
    """Per nation the first towns by population with a random factor:
    ascending, as the rule has always been, unless ``largest_first``."""
    key = F.col("population") * F.greatest(F.lit(0.5), F.least(F.lit(1.5), normal(f"{stream}seat", "fid", 1.0, 0.2)))
    w = Window.partitionBy("nation_id")
    ranked = towns.withColumn("_k", F.row_number().over(w.orderBy(F.desc(key) if largest_first else key, "fid"))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_k") <= F.floor(F.greatest(F.lit(2.0), F.col("_n") * percentage / 100))).drop("_k", "_n")


def generate_subnations(towns: DataFrame, nations: DataFrame, cultures: DataFrame, made_name: Column, percentage: float = 20.0, stream: str = "") -> DataFrame:
    """(fid, name, culture_key, center_tile_id, type_, seat_town_id, nation_id,
    color): one a seat in every nation of two towns at least, called after its
    town or, in half of the cases, by ``made_name``, a Column over the seats;
    type of its culture, colour of its nation. ``towns`` have nation_id."""
    many = towns.groupBy("nation_id").agg(F.count("*").alias("_towns")).where("_towns >= 2").select("nation_id")
    seats = subnation_seats(towns.join(many, "nation_id", "left_semi"), percentage, stream=stream)
    c = cultures.select(F.col("culture_key").alias("_c"), F.col("type_").alias("_t"))
    n = nations.select(F.col("fid").alias("nation_id"), "color")
    rows = seats.withColumn("_made", made_name).join(F.broadcast(c), F.col("culture_key") == F.col("_c"), "left").join(n, "nation_id")
    from orbisframe.operators.tables import number_rows

    numbered = number_rows(rows.withColumnRenamed("fid", "seat_town_id"), ["nation_id", "seat_town_id"], "fid")
    return numbered.select(
        "fid", F.when(uniform(f"{stream}sub_name", "seat_town_id") < 0.5, F.col("name")).otherwise(F.col("_made")).alias("name"), "culture_key",
        F.col("tile_id").alias("center_tile_id"), F.coalesce("_t", F.lit("Generic")).alias("type_"), "seat_town_id", "nation_id", "color",
    )


def subnation_cost_limit(average_area: float, percentage: float = 20.0, z: float = 0.0) -> float:
    """How much a subnation may spend on spreading; ``z`` is a standard normal
    draw, which only counts below 100 percent."""
    most = max(500.0 / average_area, 5.0)
    return most if percentage == 100 else min(max(most / 5 + 5 * z, 5.0), most) * percentage**0.5


def fill_empty_subnations(tiles: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """(fid, subnation_id, seat_town_id): in each nation the most populated
    tile without a subnation founds one, named by the negative of its fid, and
    spreads over free tiles of the nation, not through deep water, at ten times
    their area a step and up to ``limit`` in all, until none is free. Its seat
    is the town on its most populated tile with one. Nations are independent
    groups and run in parallel."""
    near = edges.where("dst is not null").groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("near"))
    rows = tiles.where("nation_id is not null").select("fid", "nation_id", "subnation_id", "population", "area", "shore_distance", "town_id")
    rows = rows.join(near, F.col("fid") == F.col("src"), "left").drop("src")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        pdf = pdf.sort_values(["population", "fid"], ascending=[False, True], ignore_index=True)
        fids = pdf["fid"].tolist()
        people, area, shore = (dict(zip(fids, pdf[c].tolist(), strict=True)) for c in ("population", "area", "shore_distance"))
        town = {f: None if pd.isna(x) else int(x) for f, x in zip(fids, pdf["town_id"], strict=True)}
        near = {f: () if n is None else n for f, n in zip(fids, pdf["near"], strict=True)}
        owner = {f: None if pd.isna(x) else int(x) for f, x in zip(fids, pdf["subnation_id"], strict=True)}
        free = {f for f in fids if owner[f] is None}
        seat: dict[int, int] = {}
        for center in fids:
            if center not in free:
                continue
            name, queue, towns = -center - 1, [(0.0, center)], []
            free.discard(center)
            while queue:
                spent, t = heapq.heappop(queue)
                owner[t] = name
                if town[t] is not None:
                    towns.append((-people[t], len(towns), town[t]))
                for n in near[t]:
                    cost = spent + 10 * area.get(n, 0.0)
                    if n in free and shore[n] >= -3 and cost <= limit:
                        free.discard(n)
                        heapq.heappush(queue, (cost, n))
            if towns:
                seat[name] = min(towns)[2]
        out = [(f, owner[f], seat.get(owner[f])) for f in fids]
        return pd.DataFrame(out, columns=["fid", "subnation_id", "seat_town_id"]).astype({"subnation_id": "Int64", "seat_town_id": "Int64"})

    return rows.groupBy("nation_id").applyInPandas(lambda pdf: work(pdf), "fid long, subnation_id long, seat_town_id long")


def assign_colors(subnations: DataFrame) -> DataFrame:
    """(fid, hue_low, hue_high): the hue circle in equal parts by nation, and
    each part by its subnations."""
    per = subnations.groupBy("nation_id").agg(F.count("*").alias("n"))
    from orbisframe.operators.tables import number_rows

    nations = number_rows(per, ["nation_id"], "k", 0).crossJoin(F.broadcast(per.agg(F.count("*").alias("all"))))
    own = F.row_number().over(Window.partitionBy("nation_id").orderBy("fid")) - 1
    j = subnations.join(nations, "nation_id").withColumn("i", own)
    step = F.lit(360.0) / F.col("all")
    return j.select("fid", (F.col("k") * step + F.col("i") * step / F.col("n")).alias("hue_low"), (F.col("k") * step + (F.col("i") + 1) * step / F.col("n")).alias("hue_high"))


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999."""
    digit = lambda d, one, five, ten: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (d % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(F.floor(n / 100), "C", "D", "M"), digit(F.floor(n / 10), "X", "L", "C"), digit(n, "I", "V", "X"))


def name_duplicates(rows: DataFrame) -> DataFrame:
    """Names that occur more than once get a roman numeral in fid order."""
    w = Window.partitionBy("name")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("fid"))
    return rows.withColumn("name", F.when(n > 1, F.concat(F.col("name"), F.lit(" "), roman(k))).otherwise(F.col("name")))


def dissolve_theme(tiles: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """(fid, theme): the tile's own value, or for water along the shore the
    majority of its neighbours, so that regions reach over the coastline."""
    from orbisframe.operators.graph import majority

    vote = majority(tiles, edges, column).select(F.col("src").alias("_v"), F.col("value").alias("_value"))
    out = tiles.join(vote, tiles["fid"] == F.col("_v"), "left")
    return out.select("fid", F.when(F.col("shore_distance") == -1, F.col("_value")).otherwise(F.col(column)).alias("theme"))
