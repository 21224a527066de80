"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from pagemill.llm.licence_digests import LICENCES, PUBLISHED, SHORT, SPELLINGS, STATEMENT
from pagemill.llm.quality_rules import RULES, STOP_WORDS
from pagemill.llm.warc_revisits import TRACKING

_WORD = r"[^\x20\x09-\x0D]+"


def _rules_sql() -> str:
    parts = [f"(case when {r.denominator} = 0 then 0.0 else {r.numerator}::double / {r.denominator} end) between {r.low} and {r.high}" for r in RULES]
    return " and ".join(parts)


#: The measures and the verdict over a relation named `documents`.
QUALITY_CTES = rf"""
base as (
  select row_number() over () as rid, *, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) as ls from documents),
windows as (select rid, unnest(range(1, len(w) - 6)) as p, w from base where len(w) > 8),
keyed as (select rid, p, array_to_string(w[p:p + 7], ' ') as k from windows),
twice as (select rid, p from keyed qualify count(*) over (partition by rid, k) > 1),
gaps as (select rid, least(8, p - coalesce(lag(p) over (partition by rid order by p), -8)) as g from twice),
repeats as (select rid, sum(g)::bigint as n from gaps group by rid),
measured as (
  select base.*, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(ls)::bigint as n_lines,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09]*[-*•·]')))::bigint as n_bullet_lines,
         len(list_filter(w, lambda x: list_contains([{', '.join("'" + w + "'" for w in STOP_WORDS)}], lower(rtrim(x, '.,;:')))))::bigint as n_stop_words,
         coalesce(repeats.n, 0)::bigint as n_repeat_words
  from base left join repeats using (rid)),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured),
quality as (select *, not base_failed and {_rules_sql()} as kept from judged)
"""

MIX_CTES = rf"""
sized as (
  select *, coalesce('=' || source, '~') as skey, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
         ((xor(coalesce(doc_id, -1), ('0x' || substr(md5(coalesce(text, '')), 1, 8))::bigint) & 2147483647) * 2654435761) % 4294967296 as mixed from MIX_INPUT),
banded as (
  select *, (length(bin(size)) * 8 + floor(size * 8 / pow(2.0, length(bin(size)))))::bigint as band, (mixed // 4194304)::bigint as bucket from sized),
totals as (select skey, sum(size)::double as total from banded group by skey),
weighted as (select skey, total, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by skey) - 1) % 3 + 1)::int] as weight from totals),
levels as (
  select *, (sum(total) over () - 3 * coalesce(sum(total) over (order by total / weight, skey rows between unbounded preceding and 1 preceding), 0.0))
         / sum(weight) over (order by total / weight, skey rows between current row and unbounded following) as lvl from weighted),
targets as (
  select skey, total::bigint as source_size, least(3 * total, coalesce(max(case when not lvl * weight > 3 * total then lvl end) over () * weight, 3 * total)) as target from levels),
placed as (
  select *, row_number() over (partition by skey order by band, bucket, size, mixed, doc_id) as upto from banded),
rated as (
  select placed.*, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
         ('0x' || substr(sha256(skey || '#0'), 1, 12))::bigint::double / 281474976710656.0 as shift from placed join targets using (skey)),
mixture as (
  select *, greatest(0, least(floor(upto * rate + shift) - floor((upto - 1) * rate + shift), 3))::bigint as copies from rated)
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"array_to_string(list_transform(string_split(lower(coalesce({text}, '')), chr(10)), lambda c: regexp_replace(regexp_replace(c, {_quoted(SHORT)}, '\\1 ', 'g'), {_quoted(STATEMENT)}, '\\5')), ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return rf"sha256(trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"


_GIVEN = ", ".join(f"({_quoted(name)}, {_quoted(d)})" for name, digests in PUBLISHED.items() for d in digests)
_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, texts in LICENCES.items() for text in texts)
LICENCE_SQL = f"""
with known as (select digest, min(licence_id) as licence_id from (select licence_id, {_canonical('body')} as digest from (values {_KNOWN}) as v(licence_id, body) union all select licence_id, digest from (values {_GIVEN}) as g(licence_id, digest)) group by digest),
rows as (select row_number() over () as rid, doc_id, text, {_canonical('text')} as digest from documents),
lines as (
  select distinct rid, {_canonical('line')} as d from (select rid, unnest(string_split(coalesce(text, ''), chr(10))) as line from rows) where line <> ''),
notices as (select rid, string_agg(distinct licence_id, ',' order by licence_id) as notices from lines join known on d = digest group by rid)
select doc_id, digest, licence_id, coalesce(notices, '') as notices from rows left join known using (digest) left join notices using (rid)"""

_PLAIN = "regexp_replace(trim(url), '#.*$', '')"
_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*://"
REVISIT_SQL = rf"""
with parts as (
  select page_id as n, url, coalesce(html, '') as html,
         regexp_replace(regexp_replace(lower(regexp_extract({_PLAIN}, '{_SCHEME}([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') as host,
         regexp_replace(regexp_extract({_PLAIN}, '{_SCHEME}[^/?]*([^?]*)', 1), '(/index\.html?|/)$', '') as path,
         list_sort(list_filter(string_split(regexp_extract({_PLAIN}, '\?(.*)$', 1), '&'), lambda q: q <> '' and not regexp_matches(lower(q), '{TRACKING}'))) as kept
  from pages where page_id is not null and url is not null),
keyed as (
  select n, url, '"' || substr(md5(html), 1, 16) || '"' as tag, length(html) as size, n * 60 as t, n * 60 + (n % 5 + 1) * 86400 + 30 as later,
         case when host <> '' then host || path || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as key from parts),
met as (
  select v.n, v.url, v.later, v.tag, r.n as rn, r.tag as rtag, r.size
  from keyed v left join keyed r on v.key = r.key and r.t < v.later
  qualify row_number() over (partition by v.n order by r.t desc nulls last, 'r' || r.n desc) = 1),
judged as (
  select *, case when rn is null then 'no_response' when n % 7 = 0 then 'mismatch' when n % 5 <> 0 then case when tag = rtag then 'resolved' else 'mismatch' end
                 when n % 30 = rn % 30 then 'resolved' else 'mismatch' end as outcome from met)
select 'v' || n as revisit_id, url, make_timestamp((1704067200 + later) * 1000000) as time, outcome,
       case when outcome = 'resolved' then 'r' || rn end as response_id,
       case when outcome = 'resolved' then array_to_string(list_sort(['cache-control: max-age=600', 'content-length: ' || size, 'content-type: text/html',
            'etag: ' || case when n % 5 <> 0 then 'W/' || tag else rtag end, 'last-modified: day ' || (n % 30), 'x-seen: ' || (n % 3)]), chr(10)) end as headers
from judged"""

#: Nodes of all trees level by level, the source trees first and then the tree of their roots; a proof is what the windows show beside a path.
_TREES = """
{name}_nodes as (
  select tree, 0 as level, place, node, count(*) over (partition by tree) as n from {name}
  union all
  select tree, level + 1, place // 3, sha256(string_agg(node, '' order by place)), (max(n) + 2) // 3 from {name}_nodes where n > 1 group by tree, level, place // 3),
{name}_sides as (
  select *, coalesce(string_agg(node, '') over (run order by place rows between unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(node, '') over (run order by place rows between 1 following and unbounded following), '') as r
  from {name}_nodes window run as (partition by tree, level, place // 3)),
{name}_proofs as (
  select d.tree, d.place, list({{'l': s.l, 'r': s.r, 'h': ''}} order by s.level) filter (where s.n > 1) as proof
  from {name} d join {name}_sides s on s.tree = d.tree and s.place = d.place // pow(3, s.level)::bigint group by d.tree, d.place),
{name}_roots as (select tree, node as root from {name}_nodes where n = 1)"""
_HELD = ", ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar"))
_BITS = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1)))"
#: CRC-32 bit by bit, the low bit of a byte first.
_CRC = f"xor(list_reduce(list_concat([4294967295::bigint], {_BITS}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
MANIFEST_SQL = f"""
with recursive told as (
  select row_number() over () as rid, doc_id, coalesce('=' || source, '') as tree, sha256(concat({_HELD}, coalesce(strlen(text) || ':' || text, '-'))) as node,
         case when {_CRC} % 2 = 0 then replace(text, chr(10), '') else text end as harmed, source, lang, n_chars from documents),
leaf_rows as (
  select rid, doc_id, tree, node, sha256(concat({_HELD}, coalesce(strlen(harmed) || ':' || harmed, '-'))) as changed,
         row_number() over (partition by tree order by doc_id nulls first, node) - 1 as place from told),
leaves as (select tree, place, node from leaf_rows), {_TREES.format(name="leaves")},
tops as (select '' as tree, row_number() over (order by tree) - 1 as place, root as node, tree as source from leaves_roots), {_TREES.format(name="tops")},
proven as (
  select d.*, r.root as subroot, t.root, list_concat(coalesce(p.proof, []), coalesce(q.proof, [])) as proof
  from leaf_rows d join leaves_proofs p using (tree, place) join leaves_roots r using (tree) join tops s on s.source = d.tree
  join tops_proofs q on q.place = s.place cross join tops_roots t),
folded as (
  select *, list_reduce(list_concat([{{'l': '', 'r': '', 'h': changed}}], proof), lambda a, b: {{'l': '', 'r': '', 'h': sha256(b.l || a.h || b.r)}}).h as folded_root from proven)
select doc_id, node as leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda p: p.l || p.r), '')) as proof_sha256, folded_root, folded_root = root as verified
from folded"""

#: Runs of one to three words counted each by itself, without a graph.
PHRASE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
worded as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces),
counted as (
  select lang, k, array_to_string(w[p:p + k - 1], ' ') as phrase, count(*) as a
  from (select lang, k, w, unnest(range(1, len(w) - k + 2)) as p from worded, (values (1), (2), (3)) as sizes(k) where len(w) >= k) group by all),
totals as (select lang, sum(a)::bigint as n from counted where k = 1 group by lang),
frequent as (select *, string_split(phrase, ' ') as w from counted where a >= 10),
around as (
  select lang, array_to_string(w[p:p + k - 1], ' ') as phrase, max(a) as longer
  from (select lang, w, a, 2 as k, unnest(range(1, len(w))) as p from frequent where len(w) = 3) group by all),
kept as (select f.* from frequent f left join around using (lang, phrase) where k > 1 and not coalesce(100 * longer >= 50 * a, false)),
cuts as (select *, unnest(range(1, k)) as cut from kept),
scored as (
  select c.lang, c.phrase, c.a, c.cut, x.a as l, y.a as r, ((1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a))::bigint as score
  from cuts c join counted x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:cut], ' ') join counted y on y.lang = c.lang and y.phrase = array_to_string(c.w[cut + 1:], ' ')),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest) join totals using (lang) where rank <= 2000"""

ORACLES = {
    "op12_phrase_graph": PHRASE_SQL,
    "op11_merkle_manifest": MANIFEST_SQL,
    "op7_licence_digests": LICENCE_SQL,
    "op9_warc_revisits": REVISIT_SQL,
    "op1_impact_search": """
        with vectors as (
          select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
          where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
          select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
          from vectors q join vectors c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
        select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
        from scored qualify rank <= 20""",
    "op3_quality_rules": f"with {QUALITY_CTES} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from quality",
    "op8_source_mix": f"with {MIX_CTES.replace('MIX_INPUT', 'documents')} select doc_id, size, source_size, target, (copies * size)::bigint as taken from mixture",
}
