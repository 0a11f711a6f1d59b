"""Water flow, lakes, rivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisframe.session import cut


def water_flow(tiles: DataFrame, edges: DataFrame, world: str | None = None) -> DataFrame:
    """(fid, water_flow, water_accumulation, flow_to): rain runs down from the
    highest tile to all lowest neighbours in equal parts; where none is lower
    or level it gathers. Descending height, then fid, is the order; what flows
    into a level tile that has had its turn stays there. An edge off the map
    (dst null) takes water away. ``world`` names the worlds of a table of
    several, which have fids of their own.

    Flow is rain times the sum of all powers of the matrix of shares, and
    shares go along an acyclic graph. The powers are doubled: with those up to
    k steps known, a join with the k-step shares gives those up to 2 k, so
    the number of rounds is the logarithm of the longest way down."""
    height = tiles.select(F.col("fid").alias("dst"), F.col("elevation").alias("low"))
    size = tiles.groupBy(*([F.col(world).alias("_w")] if world else [])).agg(F.pow(F.count("*") / F.lit(10000.0), F.lit(0.25)).alias("_scale"))
    here = tiles.select("fid", "elevation", (F.col("grouping") == "Ocean").alias("sea"), "precipitation", *([F.col(world).alias("_w")] if world else []))
    here = here.join(size, "_w") if world else here.crossJoin(F.broadcast(size))
    here = cut(here.withColumn("rain", F.when(F.col("sea"), 0.0).otherwise(F.col("precipitation") / F.col("_scale"))).drop("_scale", "precipitation"))
    near = edges.select(F.col("src").alias("fid"), "dst").distinct().join(height, "dst", "left").where("dst is null or low is not null")
    near = near.join(here.where("not sea").select("fid", "elevation"), "fid").withColumn("low", F.when(F.col("dst").isNull(), F.lit(float("-inf"))).otherwise(F.col("low")))
    least = near.groupBy("fid").agg(F.min("low").alias("least"))
    tie = (F.col("low") == F.col("least")) | (F.abs(F.col("low") - F.col("least")) < 2.220446049250313e-16)
    down = near.join(least.alias("l"), "fid").where(tie & (F.col("least") <= F.col("elevation")))
    to = down.groupBy("fid").agg(F.array_sort(F.collect_list(F.coalesce("dst", F.lit(-1)))).alias("flow_to"))
    down = cut(down.join(to.select("fid", F.size("flow_to").alias("n")), "fid").where("dst is not null").select(F.col("fid").alias("src"), "dst", (1.0 / F.col("n")).alias("share"), ((F.col("low") < F.col("elevation")) | ((F.col("low") == F.col("elevation")) & (F.col("dst") > F.col("fid")))).alias("goes_on")))

    steps = down.where("goes_on").drop("goes_on")
    through = here.select("fid", F.col("rain").alias("x"))
    while not steps.isEmpty():
        come = steps.join(through.select(F.col("fid").alias("src"), "x"), "src").where("x > 0").groupBy("dst").agg(F.sum(F.col("x") * F.col("share")).alias("more"))
        through = cut(through.join(come, F.col("fid") == F.col("dst"), "left").select("fid", (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("x")))
        second = steps.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("share").alias("part"))
        steps = cut(steps.join(second, "dst").groupBy("src", F.col("end").alias("dst")).agg(F.sum(F.col("share") * F.col("part")).alias("share")))
    stays = down.where("not goes_on").join(through.select(F.col("fid").alias("src"), "x"), "src").groupBy("dst").agg(F.sum(F.col("x") * F.col("share")).alias("more"))
    out = here.select("fid", "sea").join(through, "fid").join(stays, F.col("fid") == F.col("dst"), "left").join(to, "fid", "left")
    kept = F.when(~F.col("sea") & F.col("flow_to").isNull(), F.col("x")).otherwise(0.0)
    return out.select("fid", (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("water_flow"), kept.alias("water_accumulation"), F.coalesce("flow_to", F.array().cast("array<bigint>")).alias("flow_to"))


def lake_evaporation(temperature: Column, elevation: Column, size: Column) -> Column:
    return ((700 * (temperature + 0.006 * elevation)) / 50 + 75) / (80 - temperature) * size


def lake_climate(tiles: DataFrame, lakes: DataFrame) -> DataFrame:
    """(fid, temperature, evaporation, n_tiles): means over a lake's tiles."""
    t = tiles.where("lake_id is not null").groupBy(F.col("lake_id").alias("fid")).agg(F.avg("temperature").alias("temperature"), F.count("*").alias("n_tiles"))
    out = lakes.select("fid", "elevation").join(t, "fid")
    return out.select("fid", "temperature", lake_evaporation(F.col("temperature"), F.col("elevation"), F.col("n_tiles")).alias("evaporation"), "n_tiles")


def lake_type(temperature: Column, evaporation: Column, flow: Column, size: Column, level: Column, bottom: Column, has_outlet: Column) -> Column:
    flat = F.abs(bottom - level) < 2.220446049250313e-16
    closed = F.when(evaporation > flow / size * 4.0, "Dry").when(flat, "Pluvial").otherwise("Salt")
    return F.when(temperature < -3.0, "Frozen").when(has_outlet, F.when(flat, "Marsh").otherwise("Fresh")).otherwise(closed)


def river_segments(tiles: DataFrame, flows: DataFrame, outlets: DataFrame) -> DataFrame:
    """(from, to, to_flow, from_lake): a segment for every flow of a tile, its
    flow in equal parts, and one from each lake to its outlet's tile."""
    n = flows.groupBy("src").agg(F.count("*").alias("n"))
    part = flows.join(n, "src").join(tiles.select(F.col("fid").alias("src"), "water_flow"), "src")
    a = part.select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("water_flow") / F.col("n")).alias("to_flow"), F.lit(False).alias("from_lake"))
    b = outlets.join(tiles.select("fid", "water_flow"), "fid").select(F.col("outlet_from").alias("from"), F.col("fid").alias("to"), F.col("water_flow").alias("to_flow"), F.lit(True).alias("from_lake"))
    return a.unionByName(b)


def dedupe_segments(segments: DataFrame) -> DataFrame:
    """One row for each (from, to): largest flow, from a lake if any is."""
    return segments.groupBy("from", "to").agg(F.max("to_flow").alias("to_flow"), F.bool_or("from_lake").alias("from_lake"))


def river_topology(segments: DataFrame, lake_of: DataFrame | None = None) -> DataFrame:
    """Deduplicated segments with from_type, from_flow and to_type. Segments
    off the map (to null) end as continuing. Segments without any flow go, and
    with ``lake_of`` (fid, lake_id) those inside one lake."""
    s = dedupe_segments(segments)
    out = s.groupBy(F.col("from").alias("_o")).agg(F.count("*").alias("n_out"))
    into = s.where("to is not null").groupBy(F.col("to").alias("_i")).agg(F.count("*").alias("n_in"), F.sort_array(F.collect_list("to_flow")).alias("flows"))
    into = into.select("_i", "n_in", F.aggregate("flows", F.lit(0.0), lambda a, b: a + b).alias("flow_in"))
    j = s.join(out, F.col("from") == F.col("_o")).drop("_o")
    j = j.join(into.select(F.col("_i").alias("_f"), F.col("n_in").alias("before"), "flow_in"), F.col("from") == F.col("_f"), "left").drop("_f")
    j = j.join(into.select(F.col("_i").alias("_t"), F.col("n_in").alias("meet")), F.col("to") == F.col("_t"), "left").drop("_t")
    j = j.join(out.select(F.col("_o").alias("_n"), F.col("n_out").alias("after")), F.col("to") == F.col("_n"), "left").drop("_n")
    before, branch = F.coalesce("before", F.lit(0)), F.col("n_out") > 1
    from_type = (
        F.when(F.col("from_lake"), F.when(branch, "BranchingLake").otherwise("Lake")).when(before == 0, "Source")
        .when(before == 1, F.when(branch, "Branch").otherwise("Continuing")).otherwise(F.when(branch, "BranchingConfluence").otherwise("Confluence"))
    )
    from_flow = F.when(F.col("from_lake"), F.col("to_flow")).when(before == 0, 0.0).otherwise(F.when(branch, F.col("flow_in") / F.col("n_out")).otherwise(F.col("flow_in")))
    after, meet = F.coalesce("after", F.lit(0)), F.coalesce("meet", F.lit(0)) > 1
    to_type = (
        F.when(F.col("to").isNull(), "Continuing").when(after == 0, "Mouth").when(after == 1, F.when(meet, "Confluence").otherwise("Continuing"))
        .otherwise(F.when(meet, "BranchingConfluence").otherwise("Branch"))
    )
    res = j.select("from", "to", "from_lake", from_type.alias("from_type"), from_flow.alias("from_flow"), to_type.alias("to_type"), "to_flow").where("from_flow != 0 or to_flow != 0")
    if lake_of is None:
        return res
    a, b = lake_of.select(F.col("fid").alias("_a"), F.col("lake_id").alias("_la")), lake_of.select(F.col("fid").alias("_b"), F.col("lake_id").alias("_lb"))
    res = res.join(a, F.col("from") == F.col("_a"), "left").join(b, F.col("to") == F.col("_b"), "left")
    return res.where("_la is null or _lb is null or _la != _lb").drop("_a", "_la", "_b", "_lb")
