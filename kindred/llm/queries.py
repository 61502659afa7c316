"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chats import chat_digest, conversation_nodes, formatted_paths
from .language import languages
from .licenses import BASE, TEMPLATES, license_scan
from .lm import scores
from .mixing import mixed_sources
from .near_text import near_duplicates
from .near_vectors import near_vectors
from .secrets import secret_scan
from .sharding import sharded
from .tiling import contaminated


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], rows.schema)
    return chat_digest(formatted_paths(conversation_nodes(rows.unionByName(more))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": lambda s, d: near_vectors(_table(s, d, "embeddings"), threshold=0.98),
    "op2_language_id": lambda s, d: languages(_table(s, d, "documents")),
    "op3_mix_sources": lambda s, d: mixed_sources(_table(s, d, "documents")),
    "op4_license_scan": lambda s, d: license_scan(_table(s, d, "documents")),
    "op5_secret_scan": lambda s, d: secret_scan(_table(s, d, "documents")),
    "op6_sharding": lambda s, d: sharded(_table(s, d, "documents")),
    "op7_decontamination": lambda s, d: contaminated(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op8_chat_format": op8_chat_format,
    "op9_lm_scoring": lambda s, d: scores(_table(s, d, "documents")),
    "op10_minhash_near_dedup": lambda s, d: near_duplicates(_table(s, d, "documents"), k=4, percent=80),
}

CHAT_SQL = """with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e as (select *, length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) as r,
    length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) as n from t),
  g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as told,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    sum(length('<|im_start|>') + r + 1 + n + length('<|im_end|>') + 1) as chars from e group by conv_id)
select conv_id, n_turns, sha256(told) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from g"""

MIX_SQL = r"""with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from documents),
  s as (select source, cast(sum(size) as bigint) as z, row_number() over (order by source nulls last) as rank from d group by source),
  w as (select *, [3.0::double, 1.0::double, 2.0::double][(rank - 1) % 3 + 1] as w, 2.0::double * z as cap from s),
  o as (select *, coalesce(sum(cap) over q, 0) as cap_before, coalesce(sum(w) over q, 0) as w_before, row_number() over (order by cap / w, rank) as k from w
    window q as (order by cap / w, rank rows between unbounded preceding and 1 preceding)),
  r as (select *, (1.5::double * sum(z) over () - cap_before) / (sum(w) over () - w_before) as rate from o),
  f as (select *, (select rate from r where cap > rate * w order by k limit 1) as final from r),
  t as (select source, z, case when final is null then cap else least(cap, final * w) end as target from f),
  n as (select *, case when z > 0 then cast(floor(target / z) as bigint) else 0 end as times from t),
  g as (select d.source, h, cast(sum(size) as bigint) as zh from d group by d.source, h),
  c as (select g.source, h, zh, target - times * z as need, cast(sum(zh) over (partition by g.source order by h) as bigint) as upto from g join n on g.source is not distinct from n.source),
  e as (select source, min_by(case when need - (upto - zh) > upto - need then h + 1 else h end, h) as below from c where upto >= need group by source)
select doc_id, size, z as source_size, target, cast(size * (times + case when e.below is null or h < e.below then 1 else 0 end) as bigint) as taken
from d join n on d.source is not distinct from n.source left join e on d.source is not distinct from e.source"""

#: Components of CTE links(a, b), over vertices that CTE vertices(v) has: reach(v, w).
REACH = """links as (select a, b from pairs union all select b, a from pairs),
  reach(v, w) as (select v, v from vertices union select r.v, l.b from reach r join links l on r.w = l.a)"""

VECTOR_SQL = f"""with recursive e as (select vec_id, label, [x::double for x in embedding] as e from embeddings),
  f as (select * from e where label is not null and len(e) > 0 and len([x for x in e if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
  pairs as (select a.vec_id as a, b.vec_id as b from f a join f b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
  vertices as (select vec_id as v from e), {REACH},
  c as (select v, min(w) as component_id from reach group by v), n as (select a, count(*) as n from links group by a)
select c.v as vec_id, coalesce(n.n, 0) as n_links, component_id, c.v = component_id as kept from c left join n on c.v = n.a"""

NEAR_SQL = rf"""with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
  s as (select distinct doc_id, unnest(case when len(w) >= 4 then [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] else [array_to_string(w, ' ')] end) as s from d where len(w) > 0),
  n as (select doc_id, count(*) as n from s group by doc_id),
  i as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
  pairs as (select i.a, i.b from i join n x on i.a = x.doc_id join n y on i.b = y.doc_id where 100 * i.i >= 80 * (x.n + y.n - i.i)),
  vertices as (select doc_id as v from d), {REACH},
  c as (select v, min(w) as component_id from reach group by v)
select c.v as doc_id, coalesce(n.n, 0) as n_shingles, component_id, c.v = component_id as kept from c left join n on c.v = n.doc_id"""


def _spans_sql(kind: int, pattern: str, group: int, least: int, more: str = "true") -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    lists = f"select doc_id, source, regexp_extract_all(t, {p}) as m, regexp_extract_all(t, {p}, {group}) as v, string_split_regex(t, {p}) as g from t where regexp_matches(t, {p})"
    at = "list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0)"
    spans = f"select doc_id, source, {kind} as kind, {at} as start, {at} + length(m[i]) as stop, v[i] as value from (select *, unnest(range(1, len(m) + 1)) as i from ({lists}))"
    return f"select doc_id, source, kind, start::bigint as start, stop::bigint as stop, value from ({spans}) where length(value) >= {least} and {more}"


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIXED = "regexp_matches(value, '[0-9].*[0-9]') and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]')"
TOLD = "concat_ws(':', ['assign', 'access', 'hex', 'opaque'][kind + 1], start, stop), ',' order by start, kind"
SECRET_SQL = f"""with t as (select doc_id, source, coalesce(text, '') as t from documents),
  s as ({_spans_sql(0, ASSIGN, 1, 6)} union all {_spans_sql(1, "AKIA[A-Z0-9]+", 0, 20)} union all {_spans_sql(2, "[0-9a-f]+", 0, 24)} union all {_spans_sql(3, "[A-Za-z0-9_-]+", 0, 20, MIXED)}),
  o as (select value, count(distinct coalesce(source, chr(0))) as owners, count(distinct doc_id) as repositories from s group by value),
  l as (select s.*, owners <= 1 and repositories <= 10 as live from s join o using (value)),
  k as (select * from l where kind < 3 or (live and not exists (select 1 from s b where b.doc_id = l.doc_id and b.kind < 3 and b.start < l.stop and l.start < b.stop))),
  r as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (live) as n_live, count(*) filter (not live) as n_example,
    string_agg({TOLD}) as spans, string_agg({TOLD}) filter (kind < 3) as base from k group by doc_id)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example from t left join r on t.doc_id = r.doc_id"""


def _license_sql(least: float = 0.6, slack: int = 4) -> str:
    rows = []
    for tid, (exact, text, label, phrase) in enumerate([*((True, t, x, t) for t, x in BASE.items()), *((False, *x) for x in TEMPLATES)]):
        begin = f" {text} ".index(f" {phrase} ")
        first = len(text[:begin].split())
        rows.append(f"({tid}, {exact}, '{label}', '{text}', {first}, {first + len(phrase.split()) - 1})")
    return rf"""with t as (select *, string_split(said, ' ') as w, len(w) - 1 as pairs from (values {', '.join(rows)}) as t(tid, exact, label, said, low, high)),
  p as (select *, unnest(range(0, pairs)) as place from t),
  d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
  h as (select doc_id, tid, place, pos, pos - place as diagonal from (select doc_id, words, unnest(range(0, len(words) - 1)) as pos from d) join p on words[pos + 1] = w[place + 1] and words[pos + 2] = w[place + 2]),
  g as (select l.doc_id, l.tid, l.diagonal, list({{'place': h.place, 'pos': h.pos, 'first': h.pos, 'got': [h.place]}} order by h.place, h.pos) as hits
    from (select distinct doc_id, tid, diagonal from h) l join t on l.tid = t.tid join h on h.doc_id = l.doc_id and h.tid = l.tid and h.diagonal between l.diagonal and l.diagonal + case when t.exact then 0 else {slack} end group by all),
  c as (select doc_id, g.tid, exact, label, pairs, low, high, list_reduce(hits, lambda x, y: case when y.place > x.place and y.pos > x.pos
    then {{'place': y.place, 'pos': y.pos, 'first': x.first, 'got': list_append(x.got, y.place)}} else x end) as c from g join t on g.tid = t.tid),
  s as (select doc_id, tid, exact, label, c.first as start, c.pos + 1 as stop, len(c.got) / pairs::double as share from c
    where len(c.got) >= case when exact then pairs else {least} * pairs - 1e-9 end and list_has_all(c.got, range(low, high))),
  o as (select *, exact or coalesce(start > max(stop) over (partition by doc_id, tid order by start, stop rows between unbounded preceding and 1 preceding), true) as own from s),
  r as (select doc_id, count(*) filter (exact) as n_base, min(start) filter (exact) as first_word, max(start) filter (exact) as last_word, array_to_string(list_sort(list(distinct label) filter (exact)), ',') as base_labels,
    array_to_string(list_sort(list(distinct label)), ',') as labels, max(share) as score, string_agg(concat_ws(':', label, start, stop), ',' order by start, stop, label) filter (own) as spans from o group by doc_id)
select d.doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score, coalesce(spans, '') as spans
from d left join r on d.doc_id = r.doc_id"""


ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": VECTOR_SQL, "op3_mix_sources": MIX_SQL, "op4_license_scan": _license_sql(), "op5_secret_scan": SECRET_SQL, "op8_chat_format": CHAT_SQL, "op10_minhash_near_dedup": NEAR_SQL,
}
