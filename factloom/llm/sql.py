"""DuckDB SQL for the queries of this subpackage."""

from __future__ import annotations

from factloom.llm import quality

#: The operators' words of a text: runs of characters other than ASCII white space.
WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"


def near(words: int, percent: int) -> str:
    """Sizes of the sets of shingles and the components of their links."""
    return f"""
with recursive docs as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) w
  from documents),
grams as (
  select distinct doc_id, array_to_string(w[p : p + {words - 1}], ' ') || case when len(w) < {words} then '/' || len(w) else '' end g
  from (select *, unnest(range(1, greatest(len(w) - {words - 1}, least(len(w), 1)) + 1)) p from docs)),
sizes as (select doc_id, count(*) n from grams group by 1),
shared as (
  select x.doc_id a, y.doc_id b, count(*) n from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from shared s join sizes p on p.doc_id = s.a join sizes q on q.doc_id = s.b
  where 100 * s.n >= {percent} * (p.n + q.n - s.n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id node, doc_id root from documents union select b.b, r.root from reach r join both_ways b on b.a = r.node),
least_of as (select node, min(root) component_id from reach group by 1)
select d.doc_id, coalesce(s.n, 0) n_shingles, l.component_id
from docs d left join sizes s using (doc_id) join least_of l on l.node = d.doc_id
"""


OP1 = near(5, 75)
OP13 = f"select *, doc_id = component_id kept from ({near(4, 80)})"

OP3 = """
with items as (
  select cast(item_id as varchar) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w
  from benchmark),
grams as (
  select distinct item, least(len(w), 10) n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') g
  from (select *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) p from items where len(w) > 0)),
docs as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) w
  from documents),
sizes as (select distinct n from grams),
runs as (
  select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') g
  from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) p from docs, sizes)),
hits as (select r.doc_id, r.p, r.n, g.item from runs r join grams g on r.g = g.g and r.n = g.n),
covered as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from hits) group by 1),
named as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from hits) group by 1)
select d.doc_id, len(d.w) n_words, coalesce(c.n_hit, 0) n_hit, coalesce(m.n_items, 0) n_items,
  sha256(coalesce(m.items, '')) items_sha256, coalesce(c.n_hit, 0) > 0 contaminated
from docs d left join covered c using (doc_id) left join named m using (doc_id)
"""

OP5 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written as (
  select *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
    + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + length('<turn >') + length('</turn>') + 2 as n
  from rows)
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(n)::bigint formatted_chars
from written group by conv_id
"""

OP6 = f"""
with docs as (select doc_id, coalesce({WORDS.format("text")}, []) w from documents),
grams as (select doc_id, p, array_to_string(w[p : p + 34], ' ') g from (select *, unnest(range(1, greatest(len(w) - 33, 1))) p from docs)),
again as (select doc_id, p from (select *, count(*) over (partition by g) n from grams) where n > 1),
covered as (select distinct doc_id, unnest(range(p, p + 35)) q from again),
words as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) q from docs),
kept as (
  select doc_id, string_agg(word, ' ' order by q) kept, count(*) n
  from words w anti join covered c on w.doc_id = c.doc_id and w.q = c.q group by 1)
select d.doc_id, len(w) n_words, len(w) - coalesce(k.n, 0) n_removed, sha256(coalesce(k.kept, '')) kept_sha256
from docs d left join kept k using (doc_id)
"""

OP9 = f"""
with docs as (select doc_id, source, coalesce(text, '') text, coalesce({WORDS.format("text")}, []) w from documents),
grams as (select doc_id, p, w[p : p + 2] g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) p from docs)),
again as (select doc_id, p from (select *, count(*) over (partition by doc_id, g) n from grams) where n > 1),
covered as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + 3)) q from again) group by 1),
lines as (
  select doc_id, source, text, raw, lower(trim(regexp_replace(raw, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) line
  from (select *, unnest(string_split(text, chr(10))) raw from docs)),
words as (select *, len(string_split(line, ' ')) n from lines where line <> ''),
dup as (select doc_id, count(*) - count(distinct raw) n from words group by 1),
seen as (select source, line, count(distinct (doc_id, text)) documents from words group by 1, 2),
frequent as (select source, line from seen where documents > {quality.LINE_DOCUMENTS}),
removed as (select w.doc_id, sum(w.n) n from words w join frequent f on w.line = f.line and w.source is not distinct from f.source group by 1),
base as (
  select d.doc_id, len(w) n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols,
    coalesce(dup.n, 0) n_dup_lines, coalesce(covered.n, 0) n_repeat_words, cast(coalesce(removed.n, 0) as bigint) n_removed
  from docs d left join dup using (doc_id) left join covered using (doc_id) left join removed using (doc_id))
select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words base_failed,
  not (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
    and 100 * (n_words - n_removed) >= {quality.LEFT_PERCENT} * n_words kept
from base
"""

#: Two rounds and a last assignment; whole numbers throughout, so sums, floors and ties are exact.
OP12 = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
points as (
  select vec_id, label, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] x from (select *, unnest(range(16)) part from kept)),
book0 as (
  select part, row_number() over (partition by part order by vec_id) - 1 entry, x c from points where vec_id in (select vec_id from kept order by vec_id limit 64)),
{"".join(f"""
assigned{k} as (
  select vec_id, any_value(label) label, p.part, any_value(x) x,
    min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * 64 + entry) best
  from points p join book{k} b on p.part = b.part group by vec_id, p.part),
sums{k} as (
  select part, best % 64 entry, dim, sum(x[dim])::bigint s, count(*) n
  from (select *, unnest(range(1, len(x) + 1)) dim from assigned{k}) group by all),
means{k} as (select part, entry, list((s - ((s % n) + n) % n) // n order by dim) m from sums{k} group by all),
book{k + 1} as (select b.part, b.entry, coalesce(m, c) c from book{k} b left join means{k} using (part, entry)),""" for k in range(2))}
last as (
  select vec_id, any_value(label) label, p.part,
    min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * 64 + entry) best
  from points p join book2 b on p.part = b.part group by vec_id, p.part),
coded as (
  select vec_id, any_value(label) label, string_agg(lower(printf('%02x', (best % 64)::int)), '' order by part) code, sum(best // 64)::bigint error
  from last group by vec_id)
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) from book2) codebooks_sha256
from coded
"""

#: Steps and goals by the row before; a row's goal by a join within its segment; the chain of first rows by recursion.
OP11 = """
with recursive clean as (
  select *, floor(100 * value + 0.5)::bigint c, row_number() over (partition by client_id order by ts, click_id) p
  from (select distinct * from clicks where client_id is not null and ts is not null)),
compared as (
  select *, coalesce(kind <> 'error', false) and coalesce(c <> pc, false) and coalesce(ts - pt <= interval 15 minute, false) step,
    coalesce(kind = 'view', false) and c is not null and pc is not null and coalesce(ts - pt <= interval 15 minute, false) goal
  from (select *, lag(c) over w pc, lag(ts) over w pt from clean window w as (partition by client_id order by p))),
parts as (
  select client_id, click_id, p, c, step, goal, step and c < pc down,
    sum((not step)::int) over (partition by client_id order by p) seg, sum((not (step and c < pc))::int) over (partition by client_id order by p) fall
  from compared),
goals as (select client_id, p, c, fall, case when step then seg else seg - 1 end seg from parts where goal),
ends as (select client_id, fall, max(p) k from parts group by all),
chosen as (
  select a.client_id, a.p i, max(g.p) j, max_by(g.fall, g.p) fall
  from parts a join goals g on g.client_id = a.client_id and g.seg = a.seg and g.p > a.p and g.c >= a.c where a.c is not null group by all),
matches as (select client_id, i, j, k from chosen join ends using (client_id, fall)),
chain as (
  select client_id, min(i) i from matches group by 1
  union all
  select c.client_id, (select min(n.i) from matches n where n.client_id = c.client_id and n.i >= m.k)
  from chain c join matches m on m.client_id = c.client_id and m.i = c.i where c.i is not null),
taken as (select m.*, row_number() over (partition by m.client_id order by m.i) match_no from chain c join matches m on m.client_id = c.client_id and m.i = c.i)
select t.client_id, match_no, min_by(r.click_id, r.p) first_id, max_by(r.click_id, r.p) last_id, count(*) n_rows, sum(r.c)::bigint sum_cents,
  sha256(string_agg(case when r.p = i then 'A' when r.p = j then 'P' when down then 'D' else 'U' end, '' order by r.p)) labels_sha256
from taken t join parts r on r.client_id = t.client_id and r.p between i and k
group by t.client_id, match_no
"""

ORACLE_SQL: dict[str, str] = {"op1_ngram_join": OP1, "op3_benchmark_decontamination": OP3, "op5_chat_formatting": OP5, "op6_substring_dedup": OP6, "op9_quality_rules": OP9, "op11_row_patterns": OP11, "op12_vector_codes": OP12, "op13_superminhash": OP13}
