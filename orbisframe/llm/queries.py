"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbisframe.llm import chat, chatrepair, decontaminate, licenses, linededup, mainhtml, neardup, packing, quality, setjoin, suffixdedup, tokencount, treapsearch
from orbisframe.session import shared_folder


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract_pages(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality_model(docs, _table(spark, sf_dir, "labels"))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(c, ",")
    return out.select("doc_id", join("sentences").alias("sentence_ids"), join(F.array_sort(F.array_distinct("licenses"))).alias("licenses"), "n_licenses")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file())


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_shingles")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call has a cache of its own, so it counts every text of the table."""
    cache = tokencount.cache_folder(shared_folder(spark), uuid.uuid4().hex)
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file(), cache)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_total").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treapsearch.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chatrepair.repair_report(rows, chatrepair.damage(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_main_text, op2_suffix_dedup, op3_quality_rules, op4_license_scan, op5_decontaminate, op6_best_fit_packing, op7_minhash_near_dedup, op8_token_counts, op9_line_dedup, op10_chat_format, op11_ngram_jaccard_join, op12_treap_search, op13_conversation_repair)
    out = {f.__name__: f for f in own}
    import corpus_pipeline

    out["pipeline"] = corpus_pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": LINE_DEDUP_SQL, "op10_chat_format": CHAT_SQL, "op11_ngram_jaccard_join": JOIN_SQL, "op12_treap_search": SEARCH_SQL, "op13_conversation_repair": REPAIR_SQL}


#: Each turn is framed by 20 characters, and each control string or backslash inside it takes one more.
CHAT_SQL = r"""
with r as (
  select conv_id::bigint as conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7::bigint, 0, 'user', '</s>[INST] ok [/INST]'), (-7::bigint, 1, 'assistant', '</s>[INST] ok [/INST]')
), x as (
  select *, role || chr(10) || text || chr(10) as shown,
    20 + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '\\|<s>|\[INST\]|\[/INST\]|</s>|<image>|<audio>|<document>')) as chars
  from r
)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(shown, '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from x group by conv_id
"""


LINE_DEDUP_SQL = r"""
with l as (
  select doc_id, i - 1 as pos, x as line
  from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null) d, unnest(ls) with ordinality as u(x, i)
), w as (
  select doc_id, pos, line as a, lead(line, 1) over d as b, lead(line, 2) over d as c from l window d as (partition by doc_id order by pos)
), win as (
  select doc_id, pos, a || chr(10) || b || chr(10) || c as win from w
  where c is not null and length(regexp_replace(a || b || c, '\s+', '', 'g')) > 0
), later as (
  select doc_id, pos from (select doc_id, pos, row_number() over (partition by win order by doc_id, pos) as n from win) where n > 1
), gone as (
  select distinct doc_id, pos + k as pos from later, (values (0), (1), (2)) v(k)
), kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as text, count(*) as n from l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos
  where g.pos is null group by l.doc_id
), n as (select doc_id, count(*) as n from l group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_lines, (coalesce(n.n, 0) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join n on d.doc_id = n.doc_id left join kept k on d.doc_id = k.doc_id
"""


#: The checksum is computed byte by byte from the table of its polynomial. The
#: repair goes row by row with the cheapest letters up to each of four states
#: (0 none, 1 system, 2 user, 3 assistant read last); of two ways of one cost to
#: one state the ASCII-least stays the least whatever follows.
REPAIR_SQL = r"""
with recursive poly as (
  select list(c order by i) as t from (
    select i, list_reduce([i::bigint] || list_transform(range(8), lambda k: 0::bigint), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))
), raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), fate as (
  select r.*, xor(list_reduce([4294967295::bigint] || list_transform(string_split(k, ''), lambda c: ascii(c)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as f from raw r, poly
), hurt as (
  select conv_id, turn, case when f = 4 then 'user' else role end as role,
    case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from fate, range(case when f = 0 then 0 when f = 3 then 2 else 1 end)
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') as body, left(role, 1) as ini
  from hurt
), kinds as (
  select *, case when body = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else 'k' end as kind,
    lag(ini) over (partition by conv_id order by i) as prior
  from numbered
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (kind = 'b')::bigint as blank,
    count(*) filter (kind = 'd')::bigint as duplicate, count(*) filter (kind = 't')::bigint as truncated,
    count(*) filter (prior is not null and prior || ini not in ('su', 'ua', 'au'))::bigint as illegal, max(i) as n
  from kinds group by conv_id
), walk as (
  select conv_id, 0::bigint as i, 0 as st, 0 as ins, 0::bigint as cost, '' as audit, '' as made from counts
  union all
  select * from (
    select conv_id, i, st, ins, cost, audit, made from (
      select *, row_number() over (partition by conv_id, i, st, ins order by cost, audit) as best from (
        -- up to two empty turns go before a row and after the last one
        select conv_id, i, case when st = 2 then 3 else 2 end as st, ins + 1 as ins, cost + 3 as cost, audit || 'I' as audit, made || (case when st = 2 then chr(10) || 'assistant:' else chr(10) || 'user:' end) as made from walk where ins < 2
        union all
        select w.conv_id, w.i + 1, e.st, 0, w.cost + e.cost, w.audit || e.letter,
          w.made || (case e.letter when 'D' then '' when 'K' then chr(10) || k.role || ':' || k.text else chr(10) || (case e.st when 2 then 'user' else 'assistant' end) || ':' || k.text end)
        from walk w join kinds k on w.conv_id is not distinct from k.conv_id and k.i = w.i + 1,
          lateral (
            select 'D' as letter, w.st as st, 4 as cost
            union all select 'R', case when w.st = 2 then 3 else 2 end, 3 + (case when k.kind = 't' then 3 else 0 end) where k.kind in ('t', 'k')
            union all select 'K', case k.ini when 's' then 1 when 'u' then 2 else 3 end, case when k.kind = 't' then 3 else 0 end
              where k.kind in ('t', 'k') and ((k.ini = 's' and w.st = 0) or (k.ini = 'u' and w.st in (0, 1, 3)) or (k.ini = 'a' and w.st = 2))) e
      )
    ) where best = 1
  )
), ended as (
  select w.conv_id, w.cost, w.audit, w.made, row_number() over (partition by w.conv_id order by w.cost, w.audit) as best
  from walk w join counts c on w.conv_id is not distinct from c.conv_id and w.i = c.n where w.st in (0, 3)
)
select o.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate, coalesce(c.truncated, 0)::bigint as truncated,
  coalesce(c.illegal, 0)::bigint as illegal, coalesce(e.cost, 0)::bigint as cost, coalesce(e.audit, '') as audit, sha256(coalesce(substr(e.made, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on o.conv_id is not distinct from c.conv_id
left join ended e on o.conv_id is not distinct from e.conv_id and e.best = 1
"""


SEARCH_SQL = r"""
with dw as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from documents
), tf as (select doc_id, term, count(*) as tf from dw group by all
), size as (select doc_id, sum(tf)::bigint as n from tf group by doc_id
), total as (select count(*)::bigint as nn, sum(n)::bigint as ll from size
), w as (
  select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term, nn
), qw as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from benchmark
), scored as (
  select q.item_id, t.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * s.n * nn) // ll))))::bigint as score
  from qw q join tf t using (term) join w using (term) join size s on t.doc_id = s.doc_id, total group by q.item_id, t.doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""


JOIN_SQL = r"""
with recursive dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), sh as (
  select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g from dw, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) u(i) where len(ws) > 0
), size as (select doc_id, count(*) as n from sh group by doc_id
), pair as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by all
), link as (
  select x, y from pair join size p on p.doc_id = x join size q on q.doc_id = y where 100 * shared >= 80 * (p.n + q.n - shared)
), reach as (
  select doc_id as x, doc_id as y from dw union select reach.x, link.y from reach join link on reach.y = link.x
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, r.component_id
from dw d left join size s using (doc_id) join (select x as doc_id, min(y) as component_id from reach group by x) r using (doc_id)
"""
