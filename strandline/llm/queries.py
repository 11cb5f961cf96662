"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import contamination, dialogue, language, lm, near, phrases, pii, quality, tokens, toxicity, urls, warc

#: Host, path and verdict of the rules of op10.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), BPE)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(_table(spark, sf_dir, "documents"), BPE, keep_ids=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model_scores(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_table(spark, sf_dir, "documents"), PIECES)


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated_archives(_table(spark, sf_dir, "pages"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = _table(spark, sf_dir, "conversations")
    return dialogue.repair_report(dialogue.damaged(convs), convs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_contamination, op2_token_counts, op3_bpe, op4_pii, op5_toxicity, op6_lm, op7_quality, op8_language, op9_near, op10_urls,
        op11_warc, op12_phrases, op13_dialogue,
    )
    return {f.__name__: f for f in own}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _shingles(table: str, key: str) -> str:
    return f"""
    select distinct {key}, unnest(case
        when len(w) = 0 then []::varchar[]
        when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from (select {key}, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') as w from {table})"""


OP1_SQL = f"""
with d as ({_shingles("documents", "doc_id")}),
b as ({_shingles("benchmark", "item_id")}),
n as (select item_id, count(*) as n_item from b group by item_id)
select doc_id, item_id, n_item, count(*) as n_shared, count(*)::double / n_item as containment
from d join b using (s) join n using (item_id)
group by doc_id, item_id, n_item
having 100 * count(*) >= 75 * n_item
"""

OP9_SQL = f"""
with recursive sh as ({_shingles("documents", "doc_id")}),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
g as (select a, b from e union select b, a from e),
r as (select doc_id, doc_id as other from n union select r.doc_id, g.b from r join g on g.a = r.other),
m as (select doc_id, min(other) as low from r group by doc_id)
select doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.low, doc_id) as component_id,
    doc_id = coalesce(m.low, doc_id) as kept
from documents left join n using (doc_id) left join m using (doc_id)
"""

OP10_SQL = f"""
with rules(host, path, verdict) as (values {", ".join(map(str, URL_RULES))}),
u as (select page_id, coalesce(url, '') as url, instr(coalesce(url, ''), '://') as pos from pages),
r as (select page_id, case when pos > 0 then substr(url, pos + 3) else '' end as rest from u),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
f as (select page_id, p.host, p.path, x.host || x.path as rule, x.verdict,
    row_number() over (partition by page_id order by length(x.host) + length(x.path) desc nulls last, length(x.host) desc) as k
    from p left join rules x on (p.host = x.host or ends_with(p.host, '.' || x.host)) and starts_with(p.path, x.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where k = 1
"""


OP11_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
k as (select *, sha1(h) as x, row_number() over (partition by h order by page_id desc nulls last) as place,
    first_value(page_id) over (partition by h order by page_id desc nulls last) as top from p)
select page_id, strlen(h) as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((cast(concat('0x', substr(x, 1 + 5 * (i // 4), 5)) as bigint) >> (15 - 5 * (i % 4))) & 31), 1)), '') as payload_digest,
    case when place = 1 then 'response' else 'revisit' end as record_type,
    case when place > 1 then top end as refers_to
from k
"""

OP12_SQL = f"""
with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from t),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) as g from w, range(1, 6) as r(m) where len(w) >= m),
f as (select lang, g, count(*) as c from g group by lang, g having count(*) >= 100),
held as (select distinct q.lang, q.g[i:i + m - 1] as g, q.c from f q, range(2, 5) as r(m), range(1, 5) as s(i) where m < len(q.g) and i + m - 1 <= len(q.g)),
c as (select lang, g, c as a from f where len(g) > 1 and not exists (select 1 from held h where h.lang = f.lang and h.g = f.g and 100 * h.c >= 100 * f.c)),
k as (select c.*, k, x.c as l, y.c as r, n.n, (1000::hugeint * c.a * n.n) // (x.c::hugeint * y.c) as score
    from c join range(1, 5) as s(k) on k < len(c.g) join f x on x.lang = c.lang and x.g = c.g[1:k] join f y on y.lang = c.lang and y.g = c.g[k + 1:] join n on n.lang = c.lang),
b as (select * from k qualify row_number() over (partition by lang, g order by score, k) = 1),
o as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase, a, l, r, n, score::bigint as score from b)
select * from o where rank <= 2000
"""

#: A row's way is a cost, the edits' initials and the lines so far; of the ways to a state the least stays. Two insertions in a row are enough.
OP13_SQL = """
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as id from conversations),
crc as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(id, ''), lambda c: ascii(c)::bigint)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 as kind from raw),
hurt as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
    from crc, range(0, 2) as r(j) where kind <> 0 and (j = 0 or kind = 3)),
ids as (select conv_id, row_number() over (order by conv_id) as c from (select distinct conv_id from conversations)),
placed as (select c, turn, role, text, left(role, 1) as ini, row_number() over (partition by c order by turn nulls first, role, sha256(text)) as i from hurt join ids on hurt.conv_id is not distinct from ids.conv_id),
rows as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by c, role, text order by i) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault, lag(left(role, 1)) over (partition by c order by i) as prev from placed),
figures as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (i > 1 and prev || ini not in ('su', 'ua', 'au')) as illegal, count(*) as many from rows group by c),
ways as (
    select c, 0::bigint as i, 0 as s, {'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]} as w from figures
    union all
    select c, i, s, min(w) as w from (
        select v.c, v.i + 1 as i,
            case when op = 'D' then v.s when op = 'K' then case ini when 's' then 1 when 'u' then 2 else 3 end else case when v.s = 2 then 3 else 2 end end as s,
            {'cost': v.cost + case op when 'D' then 3 when 'K' then 0 else 2 end + (op <> 'D' and fault = 'truncated')::bigint, 'audit': v.audit || op,
             'lines': case op when 'D' then v.lines when 'K' then list_append(v.lines, role || ':' || text) else list_append(v.lines, case when v.s = 2 then 'assistant:' else 'user:' end || text) end} as w
        from (select c, i, case n when 0 then s when 1 then case when s = 2 then 3 else 2 end else case when s = 2 then 2 else 3 end end as s, w.cost + 2 * n as cost, w.audit || repeat('I', n::int) as audit,
                list_concat(w.lines, case n when 0 then [] when 1 then [case when s = 2 then 'assistant:' else 'user:' end] else case when s = 2 then ['assistant:', 'user:'] else ['user:', 'assistant:'] end end) as lines
              from ways, range(0, 3) as x(n)) v
        join rows on rows.c = v.c and rows.i = v.i + 1, (values ('D'), ('K'), ('R')) as o(op)
        where op = 'D' or (fault not in ('blank', 'duplicate') and (op = 'R' or (v.s = 0 and ini in ('s', 'u')) or (v.s in (1, 3) and ini = 'u') or (v.s = 2 and ini = 'a'))))
    group by c, i, s),
ends as (select c, min({'cost': w.cost + 2 * n, 'audit': w.audit || repeat('I', n::int),
        'lines': list_concat(w.lines, case n when 0 then [] when 1 then [case when s = 2 then 'assistant:' else 'user:' end] else ['user:', 'assistant:'] end)}) as w
    from ways join figures using (c), range(0, 3) as x(n) where i = many and ((n = 0 and s in (0, 3)) or (n = 1 and s = 2) or (n = 2 and s in (0, 1, 3))) group by c)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    coalesce(w.cost, 0) as cost, coalesce(w.audit, '') as audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) as repaired_sha256
from ids left join figures using (c) left join ends using (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_contamination": OP1_SQL, "op9_near": OP9_SQL, "op10_urls": OP10_SQL, "op11_warc": OP11_SQL, "op12_phrases": OP12_SQL, "op13_dialogue": OP13_SQL}
