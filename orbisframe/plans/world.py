"""A deterministic tile world derived from the customer, supplier, nation,
orders and lineitem-free tables, written once as SQL for two dialects.

``ctes(dialect)`` is the text; ``World`` gives the tables as DataFrames.
``U(tag,key)`` is a keyed uniform in [0, 1): it depends on the key only, so the
world is the same in any partitioning and in either engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Names of the default biomes, lake types and culture types.
BIOMES = (
    "Ocean", "Hot Desert", "Cold Desert", "Savanna", "Grassland", "Tropical Seasonal Forest", "Temperate Deciduous Forest",
    "Tropical Rainforest", "Temperate Rainforest", "Taiga", "Tundra", "Glacier", "Wetland",
)
LAKE_TYPES = ("Fresh", "Salt", "Frozen", "Pluvial", "Dry", "Marsh")
CULTURE_TYPES = ("Generic", "Lake", "Naval", "River", "Nomadic", "Hunting", "Highland")


def _pick(tag: str, key: str, names: tuple[str, ...]) -> str:
    rest = " ".join(f"when {k} then '{n}'" for k, n in enumerate(names))
    return f"(case cast(floor(U({tag},{key})*{len(names)}) as int) {rest} end)"


_TABLES: dict[str, str] = {
    "dims": "select cast(floor(sqrt(count(*))) as bigint) w from customer",
    "base": "select c_custkey k, w, PMOD(c_custkey,w) col, c_custkey IDIV w rw, c_acctbal from customer, dims where c_custkey < w*w",
    "shaped": """select k, w, col, rw, -180e0+(col+0.5e0)*(360e0/w) site_x, -90e0+(rw+0.5e0)*(180e0/w) site_y, (360e0/w)*(180e0/w) area,
        4000e0-9000e0*abs(2e0*PMOD(col*2,w)/w-1e0)*abs(2e0*rw/w-1e0)-2500e0*abs(2e0*rw/w-1e0)+c_acctbal/8e0 elevation,
        U(flow,k)*500e0 water_flow, U(prec,k)*120e0 precipitation, U(temp,k)*45e0-12e0 temperature, U(lake,k) ul,
        cast(1+floor(U(shore,k)*5) as int) us from base""",
    "towned": """select PMOD(s_suppkey*7919,(select w*w from dims)) tile, min(s_suppkey) town from supplier group by 1""",
    "tiles": f"""select s.k fid, col, rw, w, site_x, site_y, area, elevation, case when elevation<0 then 'Ocean' else 'Continent' end grouping_,
        cast(greatest(0,least(100,case when elevation>=0 then 20+floor(elevation*(80e0/9000e0)) else 20-floor(abs(elevation)*(20e0/11000e0)) end)) as int) elevation_scaled,
        water_flow, precipitation, temperature, case when elevation>=0 and ul<0.04e0 then s.k end lake_id,
        case when elevation<0 then -us else us end shore_distance,
        case when elevation>=0 and us=1 then cast(1+floor(U(wc,s.k)*3) as int) end water_count,
        case when elevation>=0 and us=1 then PMOD(col+1,w)+rw*w end harbor_tile_id,
        case when elevation<0 then 'Ocean' else {_pick('biome','s.k',BIOMES[1:])} end biome,
        case when elevation>=0 then U(hab,s.k)*30e0 else 0e0 end habitability,
        case when elevation>=0 then cast(floor(U(pop,s.k)*5000) as int) else 0 end population,
        case when elevation>=0 and U(hasc,s.k)<0.9e0 then cast(floor(U(cult,s.k)*25) as int) end culture_key,
        town town_id,
        case when elevation>=0 and U(hasn,s.k)<0.95e0 then cast(case when U(noise,s.k)<0.25e0 then floor(U(nat,s.k)*6) else PMOD((col IDIV 5)+(rw IDIV 4)*3,6) end as bigint) end nation_id,
        case when elevation>=0 and U(hasn,s.k)<0.95e0 then cast(case when U(noise2,s.k)<0.25e0 then floor(U(sub,s.k)*12) else PMOD((col IDIV 3)+(rw IDIV 3)*5,12) end as bigint) end subnation_id,
        PMOD(s.k,50) grouping_id, cast(floor(U(wind,s.k)*8)*45 as int) wind
        from shaped s left join towned t on s.k=t.tile""",
    "moves": "select * from (values (-1,-1),(0,-1),(1,-1),(-1,0),(1,0),(-1,1),(0,1),(1,1)) v(dx,dy)",
    "placed": "select fid src, col+dx c, rw+dy r, w from tiles cross join moves",
    "edges": """select src, PMOD(c+w,w)+r*w dst, case when c<0 or c>=w then 'CrossMap' else 'Tile' end kind,
        case when c<0 then 'West' when c>=w then 'East' end edge from placed where r>=0 and r<w""",
    "lakes": f"""select fid, elevation, {_pick('lt','fid',LAKE_TYPES)} type_, water_flow flow, cast(1+floor(U(ls,fid)*9) as int) size, temperature,
        U(le,fid)*200e0 evaporation, case when U(lb,fid)<0.4e0 then elevation else elevation-U(lb,fid)*100e0 end bottom_elevation, U(lo,fid)<0.5e0 has_outlet
        from tiles where lake_id is not null""",
    "cultures": f"""select cast(n_nationkey as int) culture_key, n_name name, {_pick('ct','n_nationkey',CULTURE_TYPES)} type_, 1e0+U(exp,n_nationkey) expansionism,
        PMOD(cast(n_nationkey as bigint)*997,(select w*w from dims)) center_tile_id, n_regionkey from nation""",
    "towns": """select town fid, s_name name, town tile_key, tile tile_id, PMOD(town,4)=0 is_capital, cast(1+floor(U(tpop,town)*9000) as int) population,
        s_nationkey culture_key from towned join supplier on s_suppkey=town""",
    "nations": f"""select fid, name, culture_key, tile_id center_tile_id, {_pick('nt','fid',CULTURE_TYPES)} type_, 1e0+U(nexp,fid) expansionism, fid capital_town_id
        from towns where is_capital""",
    "flows": """select fid src, PMOD(col+cast(floor(U(fd,fid)*3) as bigint)-1+w,w)+(rw-1)*w dst, case when col+cast(floor(U(fd,fid)*3) as bigint)-1 between 0 and w-1 then 'Tile' else 'CrossMap' end kind
        from tiles where elevation>=0 and rw>0 and U(nofl,fid)<0.9e0
        union all select fid, PMOD(col+1,w)+rw*w, case when col+1<w then 'Tile' else 'CrossMap' end from tiles where elevation>=0 and rw>0 and U(nofl,fid)<0.15e0""",
    "outlets": """select fid, PMOD(col+1,w)+rw*w outlet_from, case when col+1<w then 'Tile' else 'CrossMap' end kind from tiles where elevation>=0 and U(outl,fid)<0.02e0""",
    "raster": """select px, py, case when PMOD(o_orderkey,37)<>0 then o_totalprice/20e0-4000e0 end value from
        (select o_orderkey, o_totalprice, PMOD(o_orderkey,2*w) px, o_orderkey IDIV (2*w) py, w from orders, dims) where py < 2*w""",
    "words": r"""select lang, word from (select lang, WORDS(text) word from documents where text is not null) where length(word)>0""",
}

_NEEDS = {
    "base": ["dims"], "shaped": ["base"], "towned": ["dims"], "tiles": ["shaped", "towned"], "moves": [], "placed": ["tiles", "moves"], "edges": ["placed"],
    "lakes": ["tiles"], "cultures": ["dims"], "towns": ["towned"], "nations": ["towns"], "flows": ["tiles"], "outlets": ["tiles"], "raster": ["dims"],
}


def _close(text: str, at: int) -> int:
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if not depth:
            return k
    raise ValueError(text)


def render(text: str, dialect: str) -> str:
    """Replace U(), PMOD(), IDIV, WORDS() and RLIKE() by the dialect's forms."""
    spark = dialect == "spark"
    while m := re.search(r"\bU\(([\w/=]+),", text):
        end = _close(text, m.end() - len(m[1]) - 2)
        key = text[m.end() : end]
        u = f"(cast(conv(substr(md5(concat('{m[1]}:',{key})),1,8),16,10) as bigint)/4294967296e0)" if spark else f"(('0x'||substr(md5('{m[1]}:'||{key}),1,8))::BIGINT/4294967296e0)"
        text = text[: m.start()] + u + text[end + 1 :]
    text = text.replace("PMOD(", "pmod(" if spark else "mod(").replace("IDIV", "div" if spark else "//")
    text = re.sub(r"WORDS\((\w+)\)", r"explode(split(\1,'[ \n]'))" if spark else r"unnest(regexp_split_to_array(\1,'[ \n]'))", text)
    return re.sub(r"RLIKE\((\w+),", r"rlike(\1," if spark else r"regexp_matches(\1,", text)


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, []):
            add(x)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def ctes(dialect: str, names: list[str]) -> str:
    return ", ".join(f"{n} as ({render(_TABLES[n], dialect)})" for n in _closure(names))


def oracle(query: str, **more: str) -> str:
    """A DuckDB query with the world's tables that it names in front of it.
    Further keyword arguments are tables of its own, in order."""
    text = query + " ".join(more.values())
    names = [n for n in _TABLES if re.search(rf"\b{n}\b", text)]
    own = "".join(f", {k} as ({render(v, 'duckdb')})" for k, v in more.items())
    recursive = "recursive " if re.search(r"\bUSING KEY\b|/\*rec\*/", text) else ""
    return f"with {recursive}{ctes('duckdb', names)}{own} {render(query, 'duckdb')}" if names else (f"with {own[2:]} {render(query, 'duckdb')}" if own else render(query, "duckdb"))


class World:
    """Tables of the derived world, each planned on first use."""

    _BASE = ("customer", "supplier", "nation", "orders", "documents")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _TABLES:
            raise AttributeError(name)
        text = ctes("spark", [name])
        used = [t for t in self._BASE if re.search(rf"\b{t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(from|join|,)\s+{t}\b", rf"\1 {{{t}}}", text)
        got = self.spark.sql(f"with {text} select * from {name}", **{t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in used})
        setattr(self, name, got)
        return got
