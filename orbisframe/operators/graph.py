"""Neighbourhood operators over an edge table (src, dst, kind, edge)."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisframe.session import cut


def gather(tiles: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    """(src, dst, kind, n_<column>...): each edge with columns of its far end.
    Edges off the map (dst null) keep nulls; their meaning is the caller's."""
    far = tiles.select(F.col("fid").alias("dst"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return edges.select("src", "dst", "kind").join(far, "dst", "left")


def lowest_neighbors(tiles: DataFrame, edges: DataFrame, off_map_lowest: bool = True) -> DataFrame:
    """(src, lowest, to): the lowest neighbour height and all neighbours at it,
    ties within one machine epsilon. A neighbour off the map is the lowest of
    all if ``off_map_lowest``."""
    h = gather(tiles, edges, "elevation")
    height = F.when(F.col("dst").isNull(), F.lit(float("-inf"))).otherwise(F.col("n_elevation")) if off_map_lowest else F.col("n_elevation")
    h = h.withColumn("h", height)
    low = h.groupBy("src").agg(F.min("h").alias("lowest"))
    tie = (F.col("h") == F.col("lowest")) | (F.abs(F.col("h") - F.col("lowest")) < 2.220446049250313e-16)
    return h.join(low, "src").where(tie).groupBy("src").agg(F.first("lowest").alias("lowest"), F.array_sort(F.collect_list("dst")).alias("to"))


def nearest_water(tiles: DataFrame, edges: DataFrame, is_water: Column) -> DataFrame:
    """(src, harbor, water_count) of land tiles that touch water: the nearest
    water neighbour by distance, then id, and the number of water neighbours."""
    near = gather(tiles.withColumn("_w", is_water), edges, "site_x", "site_y", "_w").join(tiles.where(~is_water).select(F.col("fid").alias("src"), F.col("site_x").alias("x"), F.col("site_y").alias("y")), "src").where("n__w")
    x = F.when(F.col("kind") == "CrossMap", F.when(F.col("x") > 0, F.col("n_site_x") + 360).otherwise(F.col("n_site_x") - 360)).otherwise(F.col("n_site_x"))
    d = (x - F.col("x")) * (x - F.col("x")) + (F.col("n_site_y") - F.col("y")) * (F.col("n_site_y") - F.col("y"))
    return near.groupBy("src").agg(F.min_by("dst", F.struct(F.round(d, 9), F.col("dst"))).alias("harbor"), F.count("*").cast("int").alias("water_count"))


def majority(tiles: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """(src, value): most frequent non-null value among neighbours; equal
    counts go to the smallest value."""
    votes = gather(tiles, edges.where("kind = 'Tile'"), column).where(F.col(f"n_{column}").isNotNull()).groupBy("src", F.col(f"n_{column}").alias("value")).count()
    return votes.groupBy("src").agg(F.min_by("value", F.struct((-F.col("count")).alias("c"), F.col("value"))).alias("value"))


#: Tiles to a part, about: what one task holds of the map at a time.
PART = 50_000


def _parts(tiles: DataFrame) -> Column:
    """The part of a tile by its fid: equal ranges of fids, and neighbours
    have near fids, so most links stay inside a part."""
    n, low, high = tiles.agg(F.count("*"), F.min("fid"), F.max("fid")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(1, -(-n // PART))))
    return F.floor((F.col("fid") - F.lit(low or 0)) / width).cast("long")


def _same_medium(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """(p, src, dst, q) of links between tiles (fid, m, p) of equal m."""
    a = tiles.select(F.col("fid").alias("src"), F.col("m").alias("a"), "p")
    b = tiles.select(F.col("fid").alias("dst"), F.col("m").alias("b"), F.col("p").alias("q"))
    return edges.where("dst is not null").select("src", "dst").join(a.hint("shuffle_hash"), "src").join(b.hint("shuffle_hash"), "dst").where("a = b").select("p", "src", "dst", "q")


def _by_levels(off: np.ndarray, end: np.ndarray, step: np.ndarray, value: np.ndarray, limit: float) -> np.ndarray:
    """Least values of the tiles of a part where each step costs one, up to ``limit``:
    all of a level at once. ``off``, ``end``: links by their start."""
    level = value.min(initial=np.inf)
    while level < np.inf and level + 1 <= limit:
        here = np.flatnonzero(value == level)
        count = off[here + 1] - off[here]
        at = np.repeat(off[here] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        to = np.unique(end[at])
        to = to[value[to] > level + 1]
        value[to] = level + 1
        level = value[value > level].min(initial=np.inf)
    return value


def _by_cost(off: np.ndarray, end: np.ndarray, step: np.ndarray, value: np.ndarray, limit: float) -> np.ndarray:
    """The same with any costs of steps, cheapest tile first, up to ``limit``."""
    best, end, step, off = value.tolist(), end.tolist(), step.tolist(), off.tolist()
    queue = [(v, k) for k, v in enumerate(best) if v < np.inf]
    heapq.heapify(queue)
    while queue:
        so_far, k = heapq.heappop(queue)
        if so_far > best[k]:
            continue
        for j in range(off[k], off[k + 1]):
            total = so_far + step[j]
            if total < best[end[j]] and total <= limit:
                best[end[j]] = total
                heapq.heappush(queue, (total, end[j]))
    return np.array(best, float)


def _distances(marked: DataFrame, links: DataFrame, start: DataFrame, spread: Callable, limit: float = np.inf) -> DataFrame:
    """(fid, p, value): least sum of steps from the tiles of ``start`` (fid,
    value) along ``links`` (p, src, dst, q, w); null where none leads.

    The map is worked on in parts. In a round each part that has news goes on
    from them as far as its own links lead, and sends what crosses its border;
    it ends when nothing is sent that is nearer than what is known. Rounds are
    as many as the parts that a shortest way passes, not its steps."""

    def work(links: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = ["fid", "p", "value", "sent"]
        if not len(known) or not known["news"].notna().any():
            return pd.DataFrame([], columns=columns)
        fid = known["fid"].to_numpy(np.int64)
        order = np.argsort(fid)
        fid, old, news = fid[order], known["value"].fillna(np.inf).to_numpy(float)[order], known["news"].fillna(np.inf).to_numpy(float)[order]
        src, dst, step = np.searchsorted(fid, links["src"].to_numpy(np.int64)), links["dst"].to_numpy(np.int64), links["w"].to_numpy(float)
        inside = (links["p"] == links["q"]).to_numpy()
        own = np.flatnonzero(inside)[np.argsort(src[inside], kind="stable")]
        now = spread(np.searchsorted(src[own], np.arange(len(fid) + 1)), np.searchsorted(fid, dst[own]), step[own], np.minimum(old, news), limit)
        nearer = np.flatnonzero(now < old)
        mine = pd.DataFrame({"fid": fid[nearer], "p": int(known["p"].iloc[0]), "value": now[nearer], "sent": False})
        out = np.flatnonzero(~inside)
        out = out[(now[src[out]] < old[src[out]]) & (now[src[out]] + step[out] <= limit)]
        theirs = pd.DataFrame({"fid": dst[out], "p": links["q"].to_numpy()[out], "value": now[src[out]] + step[out], "sent": True})
        return pd.concat([x for x in (mine, theirs) if len(x)] or [mine])[columns]

    known = marked.select("fid", "p", F.lit(None).cast("double").alias("value"))
    news = start.select(F.col("fid").alias("_f"), F.col("value").cast("double").alias("news"))
    while True:
        told = known.join(news, F.col("fid") == F.col("_f"), "left").select("fid", "p", "value", "news")
        busy = told.where("news is not null").select("p").distinct()
        state = told.join(busy, "p", "left_semi")
        got = cut(links.join(busy, "p", "left_semi").groupBy("p").cogroup(state.groupBy("p")).applyInPandas(lambda a, b: work(a, b), "fid long, p long, value double, sent boolean"))
        mine = got.where("not sent").select(F.col("fid").alias("_f"), F.col("value").alias("_h"))
        known = cut(known.join(mine, F.col("fid") == F.col("_f"), "left").select("fid", "p", F.least("value", "_h").alias("value")))
        sent = got.where("sent").groupBy(F.col("fid").alias("_f")).agg(F.min("value").alias("news"))
        news = cut(sent.join(known.select(F.col("fid").alias("_f"), F.col("value").alias("_k")), "_f").where("_k is null or news < _k").select("_f", "news"))
        if news.isEmpty():
            return known


def hops(tiles: DataFrame, edges: DataFrame, seed: Column, medium: Column, limit: float = np.inf) -> DataFrame:
    """(fid, hops): steps from the nearest seed through tiles of its medium;
    seeds are at 1. Tiles that aren't reached, or not in ``limit`` steps, have null."""
    marked = tiles.select("fid", medium.alias("m"), F.coalesce(seed, F.lit(False)).alias("seed"))
    marked = cut(marked.withColumn("p", _parts(marked)))
    links = cut(_same_medium(marked, edges).withColumn("w", F.lit(1.0)))
    known = _distances(marked, links, marked.where("seed").select("fid", F.lit(1.0).alias("value")), _by_levels, limit)
    return known.select("fid", F.col("value").cast("int").alias("hops"))


def least_cost(tiles: DataFrame, edges: DataFrame, seeds: DataFrame, cost: Column, medium: Column, limit: float) -> DataFrame:
    """(fid, owner, cost): for each tile the owner whose center is the nearest
    by the costs of the tiles on the way, up to ``limit``; no way leaves its
    medium or passes a tile without a cost or another center. ``seeds``:
    owner, center. Of equally cheap ways the one counts whose last step begins
    at the smaller cost, then at the smaller tile. A center costs 1."""
    center = seeds.groupBy(F.col("center").alias("_c")).agg(F.min("owner").alias("own"))
    marked = tiles.select("fid", medium.alias("m"), cost.cast("double").alias("step")).join(center, F.col("fid") == F.col("_c"), "left").drop("_c")
    marked = cut(marked.withColumn("p", _parts(marked)))
    into = marked.where("own is null and step is not null").select(F.col("fid").alias("_f"), F.col("step").alias("w"))
    links = cut(_same_medium(marked, edges).join(into, F.col("dst") == F.col("_f")).select("p", "src", "dst", "q", "w"))
    known = cut(_distances(marked, links, marked.where("own is not null").select("fid", F.lit(0.0).alias("value")), _by_cost, limit).where("value is not null").select("fid", "value"))
    before = links.join(known.select(F.col("fid").alias("src"), F.col("value").alias("a")), "src").join(known.select(F.col("fid").alias("dst"), F.col("value").alias("b")), "dst").where("a + w = b")
    before = before.groupBy(F.col("dst").alias("fid")).agg(F.min_by("src", F.struct("a", "src")).alias("at"))
    here = marked.where("own is not null").select("fid", F.col("fid").alias("at")).unionByName(before)
    here = cut(here)
    while True:  # each tile points at the one that its own points at
        onward = here.select(F.col("fid").alias("at"), F.col("at").alias("next"))
        step = cut(here.join(onward, "at").select("fid", F.col("next").alias("at"), (F.col("next") != F.col("at")).alias("moved")))
        here = step.select("fid", "at")
        if step.where("moved").isEmpty():
            break
    own = marked.where("own is not null").select(F.col("fid").alias("at"), F.col("own").alias("owner"))
    out = here.join(own, "at").join(known, "fid")
    return out.select("fid", "owner", F.when(F.col("at") == F.col("fid"), 1.0).otherwise(F.col("value")).alias("cost"))


def shore_distance(tiles: DataFrame, edges: DataFrame, water: Column, limit: float = np.inf) -> DataFrame:
    """(fid, shore_distance): hops to the shore inside the own medium, negative
    in water; null without a shore, or beyond ``limit``."""
    marked = tiles.withColumn("_w", water)
    touch = gather(marked, edges, "_w").join(marked.select(F.col("fid").alias("src"), F.col("_w").alias("w")), "src").where("w != n__w").select(F.col("src").alias("_t")).distinct()
    marked = marked.join(touch, marked["fid"] == F.col("_t"), "left").withColumn("_seed", F.col("_t").isNotNull())
    sign = marked.select("fid", "_w")
    return hops(marked, edges, F.col("_seed"), F.col("_w"), limit).join(sign, "fid").select("fid", F.when(F.col("_w"), -F.col("hops")).otherwise(F.col("hops")).alias("shore_distance"))


def _stars(links: DataFrame) -> DataFrame:
    """(src, dst): for the tiles of each part the largest tile that they are
    linked with inside it, and the links that leave the part."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = (pdf["p"] == pdf["q"]).to_numpy()
        src, dst = pdf["src"].to_numpy(np.int64), pdf["dst"].to_numpy(np.int64)
        fid, place = np.unique(np.concatenate((src[inside], dst[inside])), return_inverse=True)
        a, b = place[: inside.sum()], place[inside.sum() :]
        label = np.arange(len(fid))
        while len(a):
            top = label.copy()
            np.maximum.at(top, label[a], label[b])
            np.maximum.at(top, label[b], label[a])
            while (top[top] != top).any():
                top = top[top]
            if (top[label] == label).all():
                break
            label = top[label]
        mine = pd.DataFrame({"src": fid, "dst": fid[label]})
        return pd.concat([mine[mine["src"] != mine["dst"]], pd.DataFrame({"src": src[~inside], "dst": dst[~inside]})])

    return links.groupBy("p").applyInPandas(lambda pdf: work(pdf), "src long, dst long")


def components(tiles: DataFrame, edges: DataFrame, klass: Column) -> DataFrame:
    """(fid, label): largest fid of the tile's component of equal class. Each
    part of the map is contracted first, to one link a tile; then neighbour
    maximum and pointer jumping run over these and the links between parts,
    over tiles that still have any. All of these tables grow with the map, so
    they are joined by shuffle; their files are small for their rows, and the
    planner would send those of each round to the driver."""
    marked = tiles.select("fid", klass.alias("m"))
    marked = cut(marked.withColumn("p", _parts(marked)))
    star = cut(_stars(_same_medium(marked, edges)))
    both = cut(star.unionByName(star.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = both.select(F.col("src").alias("fid")).distinct().withColumn("label", F.col("fid"))
    while True:
        near = both.join(label.select(F.col("fid").alias("dst"), "label").hint("shuffle_hash"), "dst").groupBy("src").agg(F.max("label").alias("n"))
        step = cut(label.join(near.hint("shuffle_hash"), label["fid"] == near["src"], "left").select("fid", F.col("label").alias("old"), F.greatest("label", F.coalesce("n", "label")).alias("label")))
        up = step.select(F.col("fid").alias("at"), F.col("label").alias("up"))
        nxt = cut(step.join(up.hint("shuffle_hash"), F.col("label") == F.col("at")).select("fid", "old", F.greatest("label", "up").alias("label")))
        if nxt.where("old != label").isEmpty():
            break
        label = nxt.select("fid", "label")
    found = nxt.select(F.col("fid").alias("_f"), F.col("label").alias("_l"))
    return marked.select("fid").join(found.hint("shuffle_hash"), F.col("fid") == F.col("_f"), "left").select("fid", F.coalesce("_l", "fid").alias("label"))


def grouping(tiles: DataFrame, edges: DataFrame, ocean: Column, lake: Column) -> DataFrame:
    """(fid, grouping, grouping_id): components of ocean, of each lake and of
    land. Land that touches the map's edge or is large is a continent; else it
    is a lake island if nothing but one lake is around, an island above a
    thousandth of the tiles, or an islet. Ids are counted from the component
    with the highest fid down."""
    klass = F.when(ocean, F.lit("ocean")).when(lake.isNotNull(), F.concat(F.lit("lake:"), lake.cast("string"))).otherwise(F.lit("land"))
    marked = tiles.withColumn("_k", klass)
    label = components(marked, edges, F.col("_k"))
    member = cut(marked.select("fid", "_k").join(label.hint("shuffle_hash"), "fid"))
    total = tiles.agg(F.count("*").alias("n_tiles"))
    size = member.groupBy("label").agg(F.count("*").alias("size"), F.first("_k").alias("k"))
    far = member.select(F.col("fid").alias("dst"), F.col("label").alias("n_label"), F.col("_k").alias("n__k")).hint("shuffle_hash")
    around = edges.select("src", "dst").join(far, "dst", "left").join(member.select(F.col("fid").alias("src"), F.col("label")).hint("shuffle_hash"), "src")
    around = around.where("dst is null or n_label != label").groupBy("label").agg(
        F.max(F.col("dst").isNull()).alias("edge"), F.max(F.coalesce(F.col("n__k") == "ocean", F.lit(False))).alias("sea"), F.count_distinct(F.when(F.col("n__k") != "ocean", F.col("n_label"))).alias("lakes")
    )
    what = size.join(around.hint("shuffle_hash"), "label", "left").crossJoin(F.broadcast(total))
    name = (
        F.when(F.col("k") == "ocean", "Ocean").when(F.col("k").startswith("lake:"), "Lake")
        .when(~F.coalesce("sea", F.lit(False)) & ~F.coalesce("edge", F.lit(False)) & (F.coalesce("lakes", F.lit(0)) == 1), "LakeIsland")
        .when(F.coalesce("edge", F.lit(False)) | (F.col("size") > F.floor(F.col("n_tiles") / 100)), "Continent")
        .when(F.col("size") > F.floor(F.col("n_tiles") / 1000), "Island").otherwise("Islet")
    )
    ids = what.select("label", name.alias("grouping"), F.col("label").alias("_l"))
    order = ids.groupBy("label", "grouping").agg(F.first("_l").alias("_l"))
    from orbisframe.operators.tables import number_rows

    ranked = number_rows(order.withColumn("_d", -F.col("label")), ["_d"], "grouping_id").drop("_d")
    return member.select("fid", "label").join(ranked.hint("shuffle_hash"), "label").select("fid", "grouping", "grouping_id")


def vertex_neighbors(vertices: DataFrame) -> DataFrame:
    """(src, dst): tiles that share a vertex, by exact equality of (x, y)."""
    a, b = vertices.select("x", "y", F.col("fid").alias("src")), vertices.select("x", "y", F.col("fid").alias("dst"))
    return a.join(b, ["x", "y"]).where("src != dst").select("src", "dst").distinct()


def antimeridian_neighbors(tiles: DataFrame, west: float, east: float) -> DataFrame:
    """(src, dst, edge): tiles on the west and the east border whose latitude
    intervals overlap; touching alone doesn't count. Tiles need x_min, x_max,
    y_min, y_max. Border tiles are joined by latitude cells, not pairwise."""
    cell = F.explode(F.sequence(F.floor("y_min").cast("long"), F.floor("y_max").cast("long")))
    a = tiles.where(F.col("x_min") == west).select(F.col("fid").alias("a"), F.col("y_min").alias("a0"), F.col("y_max").alias("a1"), cell.alias("c"))
    b = tiles.where(F.col("x_max") == east).select(F.col("fid").alias("b"), F.col("y_min").alias("b0"), F.col("y_max").alias("b1"), cell.alias("c"))
    pair = a.join(b, "c").where("a0 < b1 and b0 < a1").select("a", "b").distinct()
    return pair.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("West").alias("edge")).union(pair.select("b", "a", F.lit("East")))


def neighbor_list(edges: DataFrame) -> DataFrame:
    """(src, neighbors): off-map first, then tiles, then cross-map, by id and edge."""
    rank = F.when(F.col("kind") == "OffMap", 0).when(F.col("kind") == "Tile", 1).otherwise(2)
    item = F.struct(rank.alias("r"), F.coalesce("dst", F.lit(-1)).alias("dst"), F.coalesce("edge", F.lit("")).alias("edge"))
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(item)).alias("neighbors"))
