"""Queries of geometry, neighbours, lakes, founding, naming, colours and layer
tables, with the SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from orbisframe.functions import edges as E
from orbisframe.functions import geo
from orbisframe.operators import colors, cultures, lakes, layers, naming, neighbors, outlines, people, settle, tables, water
from orbisframe.operators import biomes as B
from orbisframe.operators.terrain import Limits
from orbisframe.plans.registry import _NRM, _VERT, G, R6, query, rings

_RECT = "select fid, col, rw, w, -180e0+(col*360e0)/w x0, -180e0+((col+1)*360e0)/w x1, -90e0+(rw*180e0)/w y0, -90e0+((rw+1)*180e0)/w y1 from tiles"
_SIDES = "(values (1,0,0),(-1,0,0),(0,1,1),(0,-1,1)) v(dx,dy,flat)"

# neighbours


@query("""select src, dst, kind, edge, mod(450e0-round(degrees(atan2(y,x))),360e0) bearing from (
  select e.src, e.dst, e.kind, case when e.kind='CrossMap' then case when a.rw=0 then 'South' when a.rw=a.w-1 then 'North' else '' end||case when a.rw in (0,a.w-1) then lower(e.edge) else e.edge end end edge,
    b.site_y-a.site_y y, case when e.kind='CrossMap' then case when a.site_x>0 then b.site_x+360e0 else b.site_x-360e0 end else b.site_x end-a.site_x x
  from edges e join tiles a on a.fid=e.src join tiles b on b.fid=e.dst where e.kind='Tile' or a.rw=b.rw)""")  # fmt: skip
def calc_neighbors(w):
    return neighbors.calc_neighbors(rings(w))


@query("""select src, dst, kind, edge, bearing from (
  select e.src, e.dst, e.kind, null::varchar edge, mod(450e0-round(degrees(atan2((b.rw-a.rw)*80e0,(b.col-a.col)*100e0))),360e0) bearing from edges e join tiles a on a.fid=e.src join tiles b on b.fid=e.dst where e.kind='Tile'
  union all select fid, null::bigint, 'OffMap', edge, (case edge when 'North' then 0 when 'Northeast' then 45 when 'East' then 90 when 'Southeast' then 135 when 'South' then 180 when 'Southwest' then 225 when 'West' then 270 else 315 end)::double
  from (select fid, case when r is null then c when c is null then r else r||lower(c) end edge from (select fid, case when rw=0 then 'South' when rw=w-1 then 'North' end r, case when col=0 then 'West' when col=w-1 then 'East' end c from tiles)) where edge is not null)""")  # fmt: skip
def neighbors_off_map(w):
    """The same tiles on a map that neither goes around nor reaches a pole."""
    x, y = (lambda d: (F.col("col") + d) * 100.0 / F.col("w")), (lambda d: (F.col("rw") + d) * 80.0 / F.col("w"))
    ring = F.array(*[F.struct(x(a).alias("x"), y(b).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    t = w.tiles.select("fid", x(0.5).alias("site_x"), y(0.5).alias("site_y"), ring.alias("ring"))
    return neighbors.calc_neighbors(t, Limits(west=0.0, south=0.0, width=100.0, height=80.0))


@query("select fid, case when c is null then r when r is null then c else r||lower(c) end edge from (select fid, case when col=0 then 'West' when col=w-1 then 'East' end c, case when rw=0 then 'South' when rw=w-1 then 'North' end r from tiles)")
def extent_on_edge(w):
    return neighbors.with_edge(rings(w)).select("fid", "edge")


@query(f"select fid, x, y, case when c is null then r when r is null then c else r||lower(c) end edge from (select *, case when x=-180e0 then 'West' when x=180e0 then 'East' end c, case when y=-90e0 then 'South' when y=90e0 then 'North' end r from ({_VERT}))")
def tuple_on_edge(w):
    v = rings(w).select("fid", F.explode("ring").alias("v")).select("fid", "v.x", "v.y")
    return v.withColumn("edge", E.point_on_edge(F.col("x"), F.col("y"), -180.0, -90.0, 360.0, 180.0))


_EDGE_ROWS = "select (['North','Northeast','East','Southeast','South','Southwest','West','Northwest'])[1+mod(fid,8)] a, (['North','Northeast','East','Southeast','South','Southwest','West','Northwest'])[1+mod(fid//8,8)] b, fid from tiles"


@query("select fid, a, b, (a=b or (length(a)>5 and (starts_with(a,b) or ends_with(a,lower(b))))) as has from ed", ed=_EDGE_ROWS)
def edge_contains(w):
    names = F.array(*map(F.lit, E.EDGES))
    t = w.tiles.select("fid", F.get(names, (F.col("fid") % 8).cast("int")).alias("a"), F.get(names, (F.expr("fid div 8") % 8).cast("int")).alias("b"))
    return t.withColumn("has", E.contains(F.col("a"), F.col("b")))


# scalar geometry


@query("select fid, round((site_x+10e0)/2,6) px, round((site_y+20e0)/2,6) py, round(site_x+degrees(atan2(n,s)),6) mx, round(degrees(atan2(sin(a)+sin(b),sqrt(s*s+n*n))),6) my from (select *, cos(a)+e s from (select fid, site_x, site_y, radians(site_y) a, radians(20e0) b, cos(radians(20e0))*cos(radians(10e0-site_x)) e, cos(radians(20e0))*sin(radians(10e0-site_x)) n from tiles))")
def midpoints(w):
    x, y, a, b = F.col("site_x"), F.col("site_y"), F.lit(10.0), F.lit(20.0)
    (px, py), (mx, my) = geo.midpoint(x, y, a, b), geo.sphere_midpoint(x, y, a, b)
    return w.tiles.select("fid", R6(px).alias("px"), R6(py).alias("py"), R6(mx).alias("mx"), R6(my).alias("my"))


@query("select fid, round(site_y+(20e0-site_y)*(185e0-site_x)/(200e0-site_x),6) flat, round(degrees(atan((tan(radians(site_y))*sin(radians(15e0))+tan(radians(20e0))*sin(radians(185e0-site_x)))/sin(radians(200e0-site_x)))),6) round_ from tiles where abs(site_x-20e0)>1e0")
def interpolate_at_longitude(w):
    t = w.tiles.where("abs(site_x - 20) > 1")
    args = (F.col("site_x"), F.col("site_y"), F.lit(200.0), F.lit(20.0), F.lit(185.0))
    return t.select("fid", R6(geo.interpolate_at_longitude(*args)).alias("flat"), R6(geo.interpolate_at_longitude(*args, sphere=True)).alias("round_"))


@query("select fid, case when e like '%est' then -180e0 when e like '%ast' then 180e0 else site_x end x, case when e like 'North%' then 90e0 when e like 'South%' then -90e0 else site_y end y from (select fid, site_x, site_y, (['North','Northeast','East','Southeast','South','Southwest','West','Northwest'])[1+mod(fid,8)] e from tiles)")
def to_edge(w):
    edge = F.get(F.array(*map(F.lit, E.EDGES)), (F.col("fid") % 8).cast("int"))
    x, y = geo.to_edge(F.col("site_x"), F.col("site_y"), edge, -180.0, -90.0, 360.0, 180.0)
    return w.tiles.select("fid", x.alias("x"), y.alias("y"))


@query("select fid, site_x+wind ax, site_y+1e0 ay, wind-site_x sx, 1e0-site_y sy, site_x*0.5e0 hx, -site_y qx, site_x qy, round(site_x/sqrt(site_x*site_x+site_y*site_y),6) ux, round(sqrt(site_x*site_x+site_y*site_y),6) size from tiles where site_x<>0e0 or site_y<>0e0")
def vectors(w):
    p, q = (F.col("site_x"), F.col("site_y")), (F.col("wind").cast("double"), F.lit(1.0))
    (ax, ay), (sx, sy), (hx, _), (qx, qy), (ux, _) = geo.add(p, q), geo.subtract(q, p), geo.multiply(p, 0.5), geo.perpendicular(p), geo.normalized(*p)
    size = geo.distance(F.lit(0.0), F.lit(0.0), *p)
    return w.tiles.where("site_x != 0 or site_y != 0").select("fid", ax.alias("ax"), ay.alias("ay"), sx.alias("sx"), sy.alias("sy"), hx.alias("hx"), qx.alias("qx"), qy.alias("qy"), R6(ux).alias("ux"), R6(size).alias("size"))


@query("select fid, round(area,4) area from tiles")
def polygon_area(w):
    r = rings(w)
    return r.select("fid", F.round(geo.ring_area(F.col("ring.x"), F.col("ring.y")), 4).alias("area"))


# outlines

_BORDER = f"""select t.k theme, sum(case when flat=0 then 180e0/t.w else 360e0/t.w end) border from kt t, {_SIDES} left join kt n on n.col=t.col+dx and n.rw=t.rw+dy where t.k is not null and n.k is distinct from t.k group by 1"""


@query("select a.theme::varchar theme, round(area,4) area, round(border,4) border from (select k theme, sum(area) area from kt where k is not null group by 1) a join br using(theme)",
       kt="select fid, col, rw, w, area, culture_key k from tiles", br=_BORDER)
def dissolve(w):
    return outlines.dissolve(rings(w), "culture_key").select("theme", F.round("area", 4).alias("area"), F.round("border", 4).alias("border"))


@query("select 'land' kind, a.theme as name, round(area,4) area, round(border,4) border from (select k theme, sum(area) area from kt where k is not null group by 1) a join br using(theme) union all select 'ocean', 'ocean', round(64800e0-(select sum(area) from kt where k is not null),4), round((select sum(border) from br),4)",
       kt="select fid, col, rw, w, area, case when grouping_<>'Ocean' then grouping_ end k from tiles", br=_BORDER)
def coastline(w):
    out = outlines.coastline(rings(w), F.col(G) == "Ocean", G, curve=None)
    return out.select("kind", "name", F.round("area", 4).alias("area"), F.round("border", 4).alias("border"))


@query(f"""select least(t.k,coalesce(n.k,t.k)) "left", case when n.k is null then null else greatest(t.k,n.k) end "right", round(sum(case when flat=0 then 180e0/t.w else 360e0/t.w end)/(case when n.k is null then 1 else 2 end),4) length
  from kt t cross join {_SIDES} left join kt n on n.col=t.col+dx and n.rw=t.rw+dy where t.k is not null and n.k is distinct from t.k group by least(t.k,coalesce(n.k,t.k)), case when n.k is null then null else greatest(t.k,n.k) end, n.k is null""",
       kt="select fid, col, rw, w, nation_id::varchar k from tiles")
def shared_borders(w):
    return outlines.shared_borders(rings(w), "nation_id", None).groupBy("left", "right").agg(F.round(F.sum("length"), 4).alias("length"))


@query("select nation_id::varchar theme, round(sum(area),4) area from tiles where nation_id is not null group by 1")
def curvify(w):
    """With straight lines, so that areas can be compared; curves are tested on their own."""
    return outlines.curvify(rings(w), "nation_id", None).select("theme", F.round("area", 4).alias("area"))


@query("select lake_id fid, true drawn from tiles where lake_id is not null group by 1")
def lake_shape(w):
    t = rings(w)
    width = layers.average_tile_area(w.tiles).first().avg_area ** 0.5
    drawn = outlines.lake_shapes(t, width).select("fid", F.col("area").alias("drawn_area"))
    size = t.where("lake_id is not null").groupBy(F.col("lake_id").alias("fid")).agg(F.sum("area").alias("area"))
    return drawn.join(size, "fid").select("fid", ((F.col("drawn_area") > 0.2 * F.col("area")) & (F.col("drawn_area") < F.col("area"))).alias("drawn"))


@query("select fid a_key, fid b_key, mod(col,2)=0 reversed from tiles")
def segment_match(w):
    line = F.array(F.col("fid"), F.col("fid") + 1, F.col("fid") * 2 + 5)
    a = w.tiles.select(F.col("fid").alias("key"), line.alias("line"))
    b = w.tiles.select(F.col("fid").alias("key"), F.when(F.col("col") % 2 == 0, F.reverse(line)).otherwise(line).alias("line"))
    return outlines.segment_match(a, b)


@query("select fid, round(case when col=w-1 then 180e0 else -180e0+((col+1)*360e0)/w end,6) x, round(site_y,6) y from tiles where harbor_tile_id is not null")
def harbor_point(w):
    h = w.tiles.where("harbor_tile_id is not null").select("fid", F.col("harbor_tile_id").alias("harbor"), F.when(F.col("col") == F.col("w") - 1, "CrossMap").otherwise("Tile").alias("kind"))
    return outlines.harbor_points(rings(w).select("fid", "ring"), h).select("fid", R6(F.col("x")).alias("x"), R6(F.col("y")).alias("y"))


@query("select fid from tiles t where exists (select 1 from towns o join tiles c on c.fid=o.tile_id where (c.site_x-t.site_x)*(c.site_x-t.site_x)+(c.site_y-t.site_y)*(c.site_y-t.site_y)<12.5e0*12.5e0)")
def points_within(w):
    towns = w.towns.select(F.col("tile_id").alias("fid")).join(w.tiles.select("fid", F.col("site_x").alias("x"), F.col("site_y").alias("y")), "fid")
    return outlines.points_within(w.tiles.select("fid", F.col("site_x").alias("x"), F.col("site_y").alias("y")), towns, 12.5).select("fid")


@query("select f.src \"from\", f.dst \"to\", round(a.site_x,6) x1, round(a.site_y,6) y1, round(b.site_x,6) x2, round(b.site_y,6) y2 from (select distinct src, dst from flows) f join tiles a on a.fid=f.src join tiles b on b.fid=f.dst")
def river_curves(w):
    s = w.flows.join(w.tiles.select(F.col("fid").alias("src"), "water_flow"), "src").select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("water_flow").alias("to_flow"), "kind")
    out = outlines.river_curves(s, w.tiles)
    first, last = F.get(F.get("lines", F.lit(0)), F.lit(0)), F.element_at(F.element_at("lines", -1), -1)
    return out.select("from", "to", R6(first["x"]).alias("x1"), R6(first["y"]).alias("y1"), R6(last["x"]).alias("x2"), R6(last["y"]).alias("y2"))


# lakes


def _filled(w):
    t = w.tiles.withColumnRenamed(G, "grouping")
    f = water.water_flow(t, w.edges).select("fid", "water_accumulation", "flow_to")
    return lakes.water_fill(t.join(f, "fid"), w.edges)


@query()
def water_fill(w):
    return _filled(w).select("fid", "lake_id", "outlet_from", R6(F.col("added_flow")).alias("added_flow"), R6(F.col("lake_elevation")).alias("lake_elevation"))


@query()
def lakes_of(w):
    return lakes.lakes_of(_filled(w)).select("fid", R6(F.col("elevation")).alias("elevation"), R6(F.col("flow")).alias("flow"), "size", "type_")


# founding

_PREF = {"Add": [{"Multiply": ["NormalizedHabitability", {"Temperature": 10}]}, {"Negate": "ShoreDistance"}]}


@query("select fid, row_number() over(order by ceil(habitability/30e0*3)*(abs(temperature-10e0)+1)+(-shore_distance::double), fid)-1 place from tiles")
def sort_preference(w):
    t = w.tiles.select("fid", "habitability", "temperature", "shore_distance")
    return cultures.sort_preference(t, _PREF, 30.0).select("fid", "place")


@query("select fid, floor(pow(U(center,fid),5e0)*100)::int idx, 0 first_ from tiles")
def biased_choice(w):
    return w.tiles.select("fid", cultures.biased_choice("center", "fid", 0, 100).alias("idx"), cultures.biased_choice("center", "fid", 0, 100, compat=True).alias("first_"))


@query("select fid, (site_x-10e0)*(site_x-10e0)+(site_y-5e0)*(site_y-5e0)<900e0 or (site_x+100e0)*(site_x+100e0)+(site_y-40e0)*(site_y-40e0)<900e0 too_close from tiles")
def too_close(w):
    p = w.tiles.select("fid", F.col("site_x").alias("x"), F.col("site_y").alias("y"))
    return cultures.too_close(p, [(10.0, 5.0), (-100.0, 40.0)], 30.0).select("fid", "too_close")


@query()
def weighted_reject_sample(w):
    rows = w.cultures.orderBy("culture_key").select("culture_key", "expansionism").collect()  # a configuration's list
    got = cultures.weighted_reject_sample([(r.culture_key, r.expansionism - 1) for r in rows], 10)
    return w.spark.createDataFrame([(k, int(x)) for k, x in enumerate(got)], "place int, culture_key int")


@query()
def generate_cultures(w):
    b = B.defaults(w.spark).select(F.col("name").alias("biome"), "supports_nomadic", "supports_hunting")
    lake = w.lakes.select(F.col("fid").alias("lake_id"), F.col("size").alias("neighboring_lake_size"))
    t = w.tiles.withColumnRenamed(G, "grouping").join(F.broadcast(b), "biome").join(lake, "lake_id", "left")
    sources = [{"name": n, "namer": n, "preferences": p} for n, p in (("A", "Habitability"), ("B", {"Negate": "Elevation"}), ("A", {"Temperature": 5}))]
    out, _ = cultures.generate_cultures(t, sources, 3)
    return out.withColumn("expansionism", R6(F.col("expansionism")))


@query(f"""select row_number() over(order by nation_id, fid) fid, case when U(sub_name,fid)<0.5e0 then name else 'State of '||name end as name, nation_id, fid seat_town_id, tile_id center_tile_id, coalesce(type_,'Generic') type_ from (
  select s.*, c.type_ from (select *, row_number() over(partition by nation_id order by population*greatest(0.5e0,least(1.5e0,1e0+0.2e0*{_NRM.format('seat')})), fid) k, count(*) over(partition by nation_id) n from (select o.fid, o.name, o.population, o.tile_id, o.culture_key, t.nation_id from towns o join tiles t on t.fid=o.tile_id where t.nation_id is not null)) s
  left join cultures c on c.culture_key=s.culture_key where n>=2 and k<=floor(greatest(2e0,n*20e0/100e0)))""")  # fmt: skip
def generate_subnations(w):
    t = w.towns.join(w.tiles.where("nation_id is not null").select(F.col("fid").alias("tile_id"), "nation_id"), "tile_id")
    nations = w.tiles.where("nation_id is not null").select(F.col("nation_id").alias("fid")).distinct().withColumn("color", F.lit("#102030"))
    out = settle.generate_subnations(t, nations, w.cultures, F.concat(F.lit("State of "), F.col("name")))
    return out.select("fid", "name", "nation_id", "seat_town_id", "center_tile_id", "type_")


@query()
def fill_empty_subnations(w):
    t = w.tiles.withColumn("subnation_id", F.when(F.col("subnation_id") < 6, F.col("subnation_id")))
    area = layers.average_tile_area(w.tiles).first().avg_area
    return settle.fill_empty_subnations(t, w.edges, settle.subnation_cost_limit(area))


# names and colours


def _suffix_sql(stem: str) -> str:
    v = "[" + naming.VOWELS.replace("'", "''") + "]"
    return f"""select fid, name, case when s is null then n when ends_with(s,'ia') then s else (case when ends_with(t2,'i') then substr(t2,1,length(t2)-1) else t2 end)||'ia' end state from (
      select *, case when regexp_matches(t1,'{v}{v}$') then substr(t1,1,length(t1)-1) else t1 end t2 from (select *, case when ends_with(s,'i') then substr(s,1,length(s)-1) else s end t1 from (select *, case
      when regexp_matches(n,'{v}{v}$') and strlen(n)>3 and u<0.85e0 then substr(n,1,length(n)-2) when not regexp_matches(n,'{v}{v}$') and regexp_matches(n,'{v}$') and strlen(n)>3 and u<0.7e0 then substr(n,1,length(n)-1)
      when not (regexp_matches(n,'{v}$') and strlen(n)>3) and u<0.6e0 then n end s from ({stem}))))"""


_STEM = "select fid, name, case when ends_with(m,'ton') and strlen(m)>5 then substr(m,1,length(m)-3) else m end n, u from (select fid, name, case when ends_with(name,'berg') and strlen(name)>6 then substr(name,1,length(name)-4) else name end m, U(suffix,fid) u from ({}))"


@query(_suffix_sql(_STEM.format("select row_number() over(order by lang, word) fid, word as name from (select distinct lang, word from words)")))
def state_name(w):
    words = tables.number_rows(w.words.distinct(), ["lang", "word"], "fid").select("fid", F.col("word").alias("name"))
    return naming.state_names(words)


_NAMES = "select culture_key fid, upper(substr(name,1,1))||lower(substr(name,2)) as name from cultures"


@query("""select fid, case when ends_with(name,'a') then substr(name,1,length(name)-1) when ends_with(name,'ia') then substr(name,1,length(name)-2) else name end trimmed, case when regexp_matches(name,'[aeiouy]$') then name else name||'o' end vowel,
  'New '||name prefix, case when regexp_matches(name,'^[AEIOUY]') then 'Ur ' else 'Ur ' end||name same, case when U(suffix_b,fid)<0.3e0 then 'land' end probable, case when strlen(name)<7 and U(suffix_b0,fid)<0.5e0 then 'ia' else 'stan' end choice from nm""", nm=_NAMES)  # fmt: skip
def state_behaviors(w):
    t = w.cultures.select(F.col("culture_key").alias("fid"), F.concat(F.upper(F.substring("name", 1, 1)), F.lower(F.expr("substr(name, 2)"))).alias("name"))
    n, f = F.col("name"), naming.apply_state_behavior
    _, probable = naming.state_suffix(n, ("ProbableSuffix", 0.3, "land"))
    _, choice = naming.state_suffix(n, ("Choice", [("ProbableSuffixIfShorter", 7, 0.5, "ia"), ("Suffix", "stan"), "NoSuffix"]))
    return t.select(
        "fid", f(n, ("TrimSuffixes", ["a", "ia"])).alias("trimmed"), f(n, ("ForceVowel", "o")).alias("vowel"), f(n, ("ForcePrefix", "New ")).alias("prefix"),
        f(n, ("ForcePrefixByLetterClass", "Ur ", "Ur ")).alias("same"), probable.alias("probable"), choice.alias("choice"),
    )


@query("select c.culture_key fid, n.namer, n.method from cultures c join (values ('ARGENTINA','Markov'),('BRAZIL','List')) n(namer, method) on n.namer=case when c.culture_key=2 then 'BRAZIL' else 'ARGENTINA' end")
def namer_lookup(w):
    known = w.spark.createDataFrame([("BRAZIL", "List"), ("ARGENTINA", "Markov")], "name string, method string")
    rows = w.cultures.select(F.col("culture_key").alias("fid"), F.when(F.col("culture_key") == 2, "BRAZIL").alias("namer"))
    return naming.namer_lookup(rows, known)


@query()
def markov_word(w):
    lengths = naming.length_statistics(w.words, "lang", "word")
    seeds = w.words.distinct()
    return naming.make_words(w.nations.select("fid", F.lit("en").alias("lang")), naming.markov_chain(w.words, "lang", "word"), lengths, "lang", "fid", naming.duplicate_letters(w.words, "lang", "word"), seeds)


_HUES = " union all ".join(f"select {k} nr, {lo}e0 lo, {hi}e0 hi, {b[0][0]}e0 s0" for k, (lo, hi, b) in enumerate(colors.HUES.values()))
_STEPS = " union all ".join(f"select {k} nr, {i} i, {s1}e0 s1, {s2}e0 s2, {v1}e0 v1, {v2}e0 v2" for k, (_, _, b) in enumerate(colors.HUES.values()) for i, ((s1, v1), (s2, v2)) in enumerate(zip(b, b[1:], strict=False)))


@query("select fid, round(h,6) hue, round(s,6) saturation, round((v0+1e0)/2,6) low from (select fid, h, s, coalesce((select v1+(s-s1)*((v2-v1)/(s2-s1)) from stp where stp.nr=x.nr and s>=s1 and s<=s2 order by i limit 1),0e0) v0 from (select d.*, s0+U(sat,fid)*(0.55e0-s0) s from (select fid, h, (select min(nr) from hue where hm>=lo and hm<=hi) nr from (select *, case when h>=334e0 then h-360e0 else h end hm from dl)) d join hue using(nr)) x)",
       hue=_HUES, stp=_STEPS, dl="select fid, (row_number() over(order by U(deal,fid), fid)-1+U(hue,fid))*360e0/count(*) over() h from nations")
def color_bounds(w):
    n = w.nations.agg(F.count("*").alias("_all"))
    d = tables.number_rows(w.nations.select("fid").withColumn("_u", colors.uniform("deal", "fid")), ["_u", "fid"], "place", 0).crossJoin(F.broadcast(n))
    d = d.withColumn("h", (F.col("place") + colors.uniform("hue", "fid")) * 360.0 / F.col("_all"))
    low, high = colors.saturation_range(F.col("h"), "Light")
    d = d.withColumn("s", low + colors.uniform("sat", "fid") * (high - low))
    return d.select("fid", R6(F.col("h")).alias("hue"), R6(F.col("s")).alias("saturation"), R6(colors.value_range(F.col("h"), F.col("s"), "Light")[0]).alias("low"))


_RGB = lambda k: f"printf('%02X', round((v-v*s*greatest(0e0,least(mod({k}e0+h/60e0,6e0),4e0-mod({k}e0+h/60e0,6e0),1e0)))*255e0)::int)"


@query(f"""select fid, '#'||{_RGB(5)}||{_RGB(3)}||{_RGB(1)} color from (select fid, h, s, (v0+1e0)/2+U(val,fid)*(1e0-(v0+1e0)/2) v from
  (select fid, h, s, coalesce((select v1+(s-s1)*((v2-v1)/(s2-s1)) from stp where stp.nr=x.nr and s>=s1 and s<=s2 order by i limit 1),0e0) v0 from (select d.*, s0+U(sat,fid)*(0.55e0-s0) s from (select fid, h, (select min(nr) from hue where hm>=lo and hm<=hi) nr from (select *, case when h>=334e0 then h-360e0 else h end hm from dl)) d join hue using(nr)) x))""",
       hue=_HUES, stp=_STEPS, dl="select fid, (row_number() over(order by U(deal,fid), fid)-1+U(hue,fid))*360e0/count(*) over() h from nations")
def random_colors(w):
    return colors.random_colors(w.nations.select("fid"))


def _hsv(r: str, g: str, b: str) -> str:
    return f"(case when greatest({r},{g},{b})=least({r},{g},{b}) then 0e0 when greatest({r},{g},{b})={r} then mod(({g}-{b})*1e0/(greatest({r},{g},{b})-least({r},{g},{b}))+6e0,6e0) when greatest({r},{g},{b})={g} then ({b}-{r})*1e0/(greatest({r},{g},{b})-least({r},{g},{b}))+2e0 else ({r}-{g})*1e0/(greatest({r},{g},{b})-least({r},{g},{b}))+4e0 end)*60e0"


@query(f"select fid, round(floor(h/36e0)*36e0,6) hue_low, round((floor(h/36e0)+1)*36e0,6) hue_high from (select fid, {_hsv('r','g','b')} h from (select fid, mod(fid*37,256) r, mod(fid*91,256) g, mod(fid*13,256) b from tiles))")
def hue_subrange(w):
    part = lambda k: F.lpad(F.hex(F.col("fid") * k % 256), 2, "0")
    t = w.tiles.select("fid", F.concat(F.lit("#"), part(37), part(91), part(13)).alias("color"))
    return colors.hue_subranges(t, 10).select("fid", R6(F.col("hue_low")).alias("hue_low"), R6(F.col("hue_high")).alias("hue_high"))


# layer tables


@query("select fid, name, population from towns union all select (select max(fid) from towns)+row_number() over(order by name), name, population from (values ('Aa',1),('Zz',2)) v(name,population)")
def add_struct(w):
    new = [{"name": "Zz", "population": 2}, {"name": "Aa", "population": 1}]
    return layers.add_struct(w.towns.select("fid", "name", "population"), "towns", new, ["name"])


@query("select fid, culture_key, elevation from tiles union all select (select max(fid) from tiles)+row_number() over(order by culture_key), culture_key, null from (select distinct culture_key from cultures)")
def insert_rows(w):
    return tables.insert_rows(w.tiles.select("fid", "culture_key", "elevation"), w.cultures.select("culture_key").distinct())


@query("select fid, case when town_id is not null then null else biome end biome, case when town_id is not null then 7e0 else elevation end elevation, town_id from tiles")
def update_row(w):
    delta = w.tiles.where("town_id is not null").select("fid", F.lit(None).cast("string").alias("biome"), F.lit(7.0).alias("elevation"))
    return tables.update_rows(w.tiles.select("fid", "biome", "elevation", "town_id"), delta)


@query("select * from (values ('elevation-limits','1'),('world-shape','Sphere')) v(name,value)")
def property_set(w):
    p = w.spark.createDataFrame([("world-shape", "Cylinder"), ("elevation-limits", "1")], "name string, value string")
    p = tables.set_property(p, "world-shape", "Sphere")
    assert tables.get_property(p, "world-shape") == "Sphere"
    return p


@query("select max(fid) fid, biome as name from tiles group by biome")
def index_by_name(w):
    return tables.index_by_name(w.tiles.select("fid", F.col("biome").alias("name"))).select("fid", "name")


@query("select t.fid, t.culture_key, c.name culture from tiles t left join cultures c on c.culture_key=t.culture_key")
def lookup_or_fail(w):
    c = w.cultures.select(F.col("culture_key").alias("k"), F.col("name").alias("culture"))
    return tables.lookup_or_fail(w.tiles.select("fid", "culture_key"), "culture_key", c, "k", "culture")


@query("select fid, site_y, elevation, grouping_ as grouping, temperature+1e0 warmer from tiles")
def project_entity(w):
    return layers.project(w.tiles.withColumnRenamed(G, "grouping"), "temperature", warmer=F.col("temperature") + 1)


@query("select fid, elevation>=100e0 and elevation<=2000e0 inclusive, elevation>=100e0 and elevation<2000e0 half_open, elevation=100e0 single from tiles")
def range_predicate(w):
    from orbisframe.operators.terrain import Span

    e = F.col("elevation")
    return w.tiles.select("fid", Span.parse("100..=2000").holds(e).alias("inclusive"), Span.parse("100..2000").holds(e).alias("half_open"), Span.parse("100").holds(e).alias("single"))
