"""DuckDB SQL twins of the registered queries."""

from __future__ import annotations

from pagemill.functions.text import _ACCENTED, _PLAIN, QUERY_STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in QUERY_STOPWORDS)
_INDEX = rf"""
terms as (
  select doc_id, unnest(regexp_extract_all(translate(lower(coalesce(text, '')), '{_ACCENTED}', '{_PLAIN}'), '[\p{{L}}\p{{N}}]+')
    || regexp_extract_all(lower(coalesce(lang, '')), '[\p{{L}}\p{{N}}]+') || regexp_extract_all(lower(coalesce(source, '')), '[\p{{L}}\p{{N}}]+')) as term from documents),
postings as (select term, doc_id, count(*) as tf from terms group by all),
lengths as (select doc_id, count(*) as dl from terms group by doc_id),
stats as (select term, count(*) as df, sum(tf)::bigint as cf from postings group by term),
totals as (select (select count(*) from documents) as n, (select sum(dl) from lengths)::double / (select count(*) from documents) as avgdl)"""
_CONTENT = f"lambda t: length(t) > 2 and t not in ({_STOP})"
_SCORED = """
wanted as (select query_id, term, count(*) as times from (select query_id, unnest(ts) as term from asked) group by all),
parts as (
  select query_id, p.doc_id as id, w.term,
         times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as part
  from wanted w join stats using (term) join postings p using (term) join lengths l on l.doc_id = p.doc_id cross join totals),
scored as (select query_id, id, sum(part) as score, count(*) as met from parts group by all),
needed as (select query_id, count(*) as needed, sum(times) as asked from wanted group by query_id)"""
_ASKED = rf"""
asked as (
  select item_id as query_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2 and t not in ({_STOP})) as ts from benchmark),
{_SCORED},
lexical as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from scored qualify rank <= 20),
coverage as (
  select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank
  from scored join needed using (query_id) where met = needed and asked > 1 qualify rank <= 20)"""
_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_EDGES = f"^[{_SPACE}]+|[{_SPACE}]+$"
_ENDS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_PROBES = rf"""
long as (select source || '.md' as book_file, min(doc_id) as id, min_by(text, doc_id) as text from documents where length(text) > 600 group by 1),
sentences as (select book_file, id, generate_subscripts(ss, 1) - 1 as no, unnest(ss) as sentence from (select book_file, id, string_split(regexp_replace(text, '([.!?])[{_SPACE}]+', '\1' || chr(1), 'g'), chr(1)) as ss from long)),
told as (select *, list_filter(regexp_extract_all(lower(sentence), '[a-z0-9]+'), {_CONTENT}) as ts from sentences),
rated as (select book_file, id, no, sentence, round(avg(1.0::double / (1 + coalesce(cf, 0))), 9) as rare from (select book_file, id, no, sentence, unnest(ts) as term from told where len(ts) between 6 and 25) left join stats using (term) group by 1, 2, 3, 4),
probe as (select book_file, id, substr(regexp_replace(regexp_replace(sentence, '[{_SPACE}]+', ' ', 'g'), '^ | $', '', 'g'), 1, 160) as query from rated qualify row_number() over (partition by book_file, id order by rare desc, no) = 1)"""
_FUSED = """
each_ as (select query_id, id, sum(1.0::double / (rank + 60)) as s, min(channel * 1000 + rank) as first, max(score) as raw from both_ group by all),
ways as (select query_id, count(distinct channel) as ways from both_ group by 1),
fused as (select query_id, id, first, case when ways = 1 then raw else s end as score, case when ways = 1 then 0.0 else round(s, 12) end as ord from each_ join ways using (query_id))"""
_CENTROIDS = """
dims as (select label, generate_subscripts(embedding, 1) as dim, unnest(embedding)::double as x from embeddings),
means as (select label, dim, round(avg(x), 6) as x from dims group by all),
centroids as (select label as query_id, list(x order by dim) as vec from means group by label),
hits as (
  select query_id, vec_id, list_inner_product(embedding::double[], vec) as score from embeddings, centroids)"""
_TYPE = rf"""case when regexp_matches(coalesce(text, ''), '(?i)\b(isbn|first published|all rights reserved|catalogu(?:e|ing)[- ]in[- ]publication|library of congress|printed in|no part of this (?:book|publication))\b|©') then 'IMPRINT'
  when length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) < 280 and len(list_filter(regexp_extract_all(text, '###\s*Page\s+([0-9]+)', 1), lambda x: x::bigint >= 4)) = 0 then 'COVER'
  when len(regexp_extract_all(text, '###\s*Page\s+([0-9]+)', 1)) >= 2 then 'SPREAD' else 'PAGE' end"""
_QUALITY = r"""
  select doc_id, text, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nl}\p{No}]{2,}') as w,
         list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls,
         list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') as t from documents"""
_UNITS = "select source || '.md' as book_file, source as book_title, lang as author, doc_id || '.jpeg' as image, text from documents"
_TURNS = "select 'book_' || conv_id || '.md' as book_file, format('IMG_{:04d}.jpeg', turn) as image, turn as position, role, text from conversations"
_SESSIONS = """
  marked as (
    select *, case when lag(ts) over o is null or epoch_us(ts) - epoch_us(lag(ts) over o) > 21600000000 then 1 else 0 end as s from events window o as (partition by user_id order by ts, event_id)),
  numbered as (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) as session_no from marked)"""

ORACLES = {
    "term_stats": f"with {_INDEX} select term, df, cf from stats where cf >= 2",
    "lexical_topk": f"with {_INDEX}, {_ASKED} select query_id, id, round(score, 4) as score, rank from lexical",
    "coverage_topk": f"with {_INDEX}, {_ASKED} select query_id, id, round(score, 4) as score, rank from coverage",
    "rrf_fusion": f"""with {_INDEX}, {_ASKED},
      both_ as (select query_id, id, rank, score, 0 as channel from lexical union all select query_id, id, rank, score, 1 from coverage), {_FUSED}
      select query_id, id, round(score, 9) as score, row_number() over (partition by query_id order by ord desc, first, id) as rank from fused""",
    "scoped_search": f"""with {_INDEX}, {_ASKED},
      scope as (select doc_id from documents where source in (select source from documents where concat_ws(' ', source || '.md', source, lang) ilike '%src1%' and concat_ws(' ', source || '.md', source, lang) ilike '%fr%')),
      nearest as (
        select item_id as query_id, w.vec_id as id, list_inner_product(w.embedding::double[], q.embedding::double[]) as score
        from benchmark join embeddings q on q.vec_id = item_id join (select * from embeddings where vec_id in (select doc_id from scope)) w on true),
      dense as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from nearest qualify rank <= 20),
      within as (select * from scored where id in (select doc_id from scope)),
      lexical_in as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from within qualify rank <= 20),
      coverage_in as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from within join needed using (query_id) where met = needed and asked > 1 qualify rank <= 20),
      both_ as (select query_id, id, rank, score, 0 as channel from dense union all select query_id, id, rank, score, 1 from lexical_in union all select query_id, id, rank, score, 2 from coverage_in), {_FUSED}
      select query_id, id, round(score, 9) as score, rank from (select *, row_number() over (partition by query_id order by ord desc, first, id) as rank from fused) where score >= 0.016""",
    "cells_topk": f"with {_CENTROIDS} select query_id, vec_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from hits qualify rank <= 20",
    "dense_topk": f"with {_CENTROIDS} select query_id, vec_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from hits qualify rank <= 20",
    "dense_maxpool": f"""with {_CENTROIDS},
      top as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as r from hits qualify r <= 80),
      best as (select query_id, vec_id // 4 as chunk_id, max(score) as score from top group by all)
      select query_id, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from best qualify rank <= 20""",
    "recall_by_label": f"""with {_CENTROIDS},
      top as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as r from hits qualify r <= 20),
      first as (select query_id, min(case when label = query_id then r end) as f from top join embeddings using (vec_id) group by query_id)
      select count(*) as probes, round(avg(case when f <= 1 then 1.0 else 0.0 end), 6) as r1, round(avg(case when f <= 3 then 1.0 else 0.0 end), 6) as r3,
             round(avg(case when f <= 5 then 1.0 else 0.0 end), 6) as r5, round(avg(coalesce(1.0 / f, 0.0)), 6) as mrr from first""",
    "exact_dedup": """with f as (select doc_id || '.jpeg' as name, sha256(coalesce(text, '')) as sha256 from documents),
      c as (select sha256, list(name order by length(name), name) as names from f group by sha256)
      select sha256, names[1] as canonical, array_to_string(list_sort(names[2:]), ',') as dropped, len(names) as n from c""",
    "duplicate_passages": "select substr(text, 1, 200) as passage, count(distinct doc_id) as n from documents group by 1 having n > 1",
    "benchmark_containment": "select distinct doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) where b.text <> ''",
    "prompt_echo": """select distinct doc_id from documents d
      join (select distinct line from (select unnest(string_split(text, chr(10))) as line from benchmark) where length(line) >= 40) on contains(d.text, line)""",
    "running_headers": rf"""with l as (select doc_id, list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '({_ENDS})\z', ''), '{_ENDS}'), lambda x: regexp_replace(x, '{_EDGES}', '', 'g')) as ls, coalesce(text, '') as t from documents),
      b as (select *, list_filter(list_transform(ls, lambda x: regexp_replace(regexp_replace(x, '^[#>* ]+', ''), '{_EDGES}', '', 'g')), lambda x: x <> '' and not regexp_matches(x, '^(?i)(page\s+)?[0-9]{{1,4}}$')) as said,
              list_transform(regexp_extract_all(t, '###\s*Page\s+([0-9]+)', 1), lambda n: n::int) as headed, list_transform(list_filter(ls, lambda x: regexp_matches(x, '^[0-9]{{1,4}}$')), lambda n: n::int) as alone from l)
      select doc_id, coalesce(said[1], '') as header, array_to_string(case when len(headed) > 0 then headed else alone[1:1] end, ',') as page_numbers from b""",
    "probe_candidates": f"with {_INDEX}, {_PROBES} select book_file, id, query from probe",
    "probe_recall": f"""with {_INDEX}, {_PROBES},
      asked as (select id as query_id, list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), {_CONTENT}) as ts from probe), {_SCORED},
      ranks as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from scored qualify rank <= 5),
      first as (select p.id, min(case when r.id = p.id then rank end) as f from probe p left join ranks r on r.query_id = p.id group by 1)
      select count(*) as probes, round(avg(case when f <= 1 then 1.0 else 0.0 end), 6) as r1, round(avg(case when f <= 3 then 1.0 else 0.0 end), 6) as r3,
             round(avg(case when f <= 5 then 1.0 else 0.0 end), 6) as r5, round(avg(coalesce(1.0 / f, 0.0)), 6) as mrr from first""",
    "page_quality": f"""with q as ({_QUALITY}),
      m as (select *, case when len(ls) > 0 then len(list_distinct(ls))::double / len(ls) else 1.0 end as lu,
              len(list_distinct(list_transform(generate_series(1, len(t) - 2), lambda i: t[i:i + 2])))::double / nullif(len(t) - 2, 0) as tu from q)
      select doc_id, case when len(w) < 5 then 1.0::double else round_even(len(list_filter(w, lambda x: regexp_matches(lower(x), '[aeiouyà-öø-ÿ]')))::double / len(w) * least(lu, case when len(t) >= 30 then tu else 1.0 end), 3) end as quality,
             len(ls) >= 10 and least(lu, case when len(t) >= 32 then tu else 1.0 end) < 0.1 as runaway,
             length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g')) as letters from m""",
    "shot_types": f"select doc_id, {_TYPE} as type from documents",
    "metadata_fields": r"""select doc_id,
      nullif(trim(regexp_extract(text, '(?i)\bISBN[:\s]*((?:97[89][\s-]?)?[0-9][0-9\s-]{7,14}[0-9Xx])', 1)), '') as isbn,
      nullif(regexp_extract(text, '(?i)(?:©|\(c\)|copyright|first published)[^\n]*?\b((?:19|20)[0-9]{2})\b', 1), '') as year,
      nullif(trim(regexp_extract(text, '(?i)published[^\n]*?\bby\b[:\s]*\n?\s*([^\n]+)', 1)), '') as publisher,
      regexp_replace(regexp_extract(text, '\b([A-Z]{1,3}[0-9]{3}[.0-9]*\s*/\s*[0-9]{1,3})\b', 1), '\s+', '', 'g') as call_number from documents""",
    "capture_order": """with e as (select event_id, user_id, case when event_id % 5 <> 0 then ts end as ts from events),
      c as (select *, last_value(ts ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as carried from e)
      select event_id, user_id, row_number() over (partition by user_id order by carried nulls first, event_id) as capture_no from c""",
    "session_books": f"with {_SESSIONS} select user_id, session_no::bigint as session_no, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from numbered group by all",
    "session_windows": f"with {_SESSIONS} select user_id, n, first_ts, last_ts from (select user_id, session_no, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from numbered group by all)",
    "neighbour_pages": f"""with t as ({_TURNS}), placed as (select *, dense_rank() over (partition by book_file order by image) as place from t),
      hits as (select book_file, min(image) as image from t where role = 'user' group by 1),
      centre as (select distinct p.book_file, p.image as hit, place as centre from placed p join hits using (book_file, image))
      select p.book_file, p.image, hit from placed p join centre c using (book_file) where abs(place - centre) <= 1""",
    "merge_tiny": f"""with t as ({_TURNS}),
      u as (select *, sum(case when length(text) >= 200 or first then 1 else 0 end) over (partition by book_file order by position rows unbounded preceding) as unit
            from (select *, row_number() over (partition by book_file order by position) = 1 as first from t)),
      g as (select book_file, unit, min(position) as position, min_by(image, position) as image, string_agg(text, chr(10) || chr(10) order by position) as text from u group by book_file, unit),
      s as (select *, unit = 1 and length(text) < 200 and lead(unit) over w is not null as stub, lag(text) over w as before, lag(unit) over w as before_unit from g window w as (partition by book_file order by unit)),
      x as (select *, case when before_unit = 1 and length(before) < 200 then before || chr(10) || chr(10) || text else text end as whole from s)
      select book_file, position, image, whole as text from x where not stub""",
    "books_listing": f"select book_file, book_title, author, count(*) as n_chunks, count(distinct image) as n_images from ({_UNITS}) group by 1, 2, 3",
    "catalog_summary": f"""select count(*) as n_chunks, count(distinct book_file) as n_books, 0::bigint as n_paged, count(case when coalesce(author, '') <> '' then 1 end) as n_authored,
      min(length(text)) as min_chars, max(length(text)) as max_chars, round(avg(length(text)), 3) as avg_chars from ({_UNITS})""",
    "scope_books": f"select distinct book_file, book_title, author from ({_UNITS}) where concat_ws(' ', book_file, book_title, author) ilike '%src1%' and concat_ws(' ', book_file, book_title, author) ilike '%fr%'",
    "catalog_diff": """with o as (select doc_id as id, case when lang = 'fr' then 'old' else sha1(coalesce(text, '')) end as a from documents where lang <> 'es'),
      n as (select doc_id as id, sha1(coalesce(text, '')) as b from documents where lang <> 'de')
      select case when b is null then 'STALE' when a is null then 'NEW' when a = b then 'KEPT' else 'CHANGED' end as status, count(*) as n from o full join n using (id) group by 1""",
    "doctor_report": f"""with c as ({_UNITS}), d as (select substr(text, 1, 200) as head from c group by 1 having count(distinct image) > 1),
      w as (select text, embedding, case when lang = 'de' then 'old' else 'm' end as model from documents left join embeddings on vec_id = doc_id),
      v as (select count(*) as n, count(embedding) as v, count(case when model <> 'm' then 1 end) as s from w),
      p as (select count(*) as n from benchmark where not exists (select 1 from c where contains(lower(book_file), 'src' || (item_id % 40) || '.'))),
      g as (select count(distinct image) as n from c)
      select case when count(*) = 0 then 'WARN' else 'OK' end as level, 'corpus' as name, count(*) || ' chunks, ' || count(distinct book_file) || ' books' as message from c
      union all select case when count(*) > 0 then 'WARN' else 'OK' end, 'uncitable-labels', count(*)::varchar from c where not regexp_matches(lower(image), '\\.(jpe?g|png|tiff?|heic)$')
      union all select case when v < n or s > 0 then 'WARN' else 'OK' end, 'vectors', (n - v) || ' without, ' || s || ' of another model' from v
      union all select case when count(*) > 0 then 'WARN' else 'OK' end, 'truncation', count(*)::varchar from w where length(text) > 2048
      union all select case when count(*) > 28500 then 'WARN' else 'OK' end, 'scale', count(*)::varchar from c
      union all select case when count(*) > 0 then 'INFO' else 'OK' end, 'duplicates', count(*)::varchar from d
      union all select case when n > 0 then 'WARN' else 'OK' end, 'probes', n::varchar from p
      union all select case when abs(n - 700) > 14 then 'WARN' else 'OK' end, 'ocr-rag-gap', n || ' of 700' from g""",
    "book_round_trip": f"select book_file, book_file as book_title, '1999' as year, image, position::varchar as page, text from ({_TURNS})",
}
ORACLES["coverage_summary"] = f"""with q as ({_QUALITY}),
  m as (select *, {_TYPE} as type, trim(text, ' \t\n\r') as body, case when len(ls) > 0 then len(list_distinct(ls))::double / len(ls) else 1.0 end as lu,
          case when len(t) >= 32 then len(list_distinct(list_transform(generate_series(1, len(t) - 2), lambda i: t[i:i + 2])))::double / (len(t) - 2) else 1.0 end as tu from q),
  r as (select *, type in ('COVER', 'IMPRINT') as meta, len(ls) >= 10 and least(lu, tu) < 0.1 as runaway from m)
  select case when not meta or (length(body) >= 400 and not runaway) then 'emitted' when length(body) < 400 then 'thin-text' when runaway then 'runaway-healed' else 'meta-below-recovery-gate' end as reason,
         count(*) as n, sum(length(text))::bigint as chars from r group by 1"""
