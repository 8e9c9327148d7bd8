"""More registered queries: search queries, quantities, relevance, passages, evaluation, reports, models and the product query."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import claims as C
from factloom.functions import lexicon as L
from factloom.functions import quantities as Q
from factloom.functions.patterns import exploded
from factloom.operators import evaluation as V
from factloom.operators import evidence as E
from factloom.operators import passages as P
from factloom.operators import relevance as R
from factloom.operators import reporting as W
from factloom.operators import search as S
from factloom.plans import verdict
from factloom.queries import (
    CLAIM_STANCE_SQL, CLAIMS_SQL, DECOMPOSED_SQL, DEDUP_SQL, EVENT_LIST, EVIDENCE_SQL, FACTS_SQL, JUDGED_SQL, MARKER_SQL, OPPOSITE_CASE, PREDICATE_SQL, RESULTS, SCORES_SQL, SENTENCES_SQL, STANCE, TRIAGE_SQL, UNIQUE,
    claims_view, evidence_view, listed, normalise_sql, register, rx, scores_view, sql_text, table,
)

FORMS = list(dict.fromkeys(f for forms in L.EVENT_SURFACES.values() for f in forms))
#: A claim's surface forms: the claim with all but letters and spaces as marks, so that a form stands between a space or mark on either side.
BOUNDED = " || ' ' || regexp_replace(lower(claim), '[^a-z ]', '#', 'g') || ' '"
PLACES = ", ".join(f"instr(p, '{a}' || f || '{b}')" for a in " #" for b in " #")
FORMS_SQL = f"""
with c as (select claim_id, claim, ''{BOUNDED} p from ({CLAIMS_SQL})),
s as (select claim_id, claim, list_sort(list_filter(list_transform({listed(FORMS)}, lambda f: {{'at': list_min(list_filter([{PLACES}], lambda x: x > 0)), 'f': f}}), lambda x: x.at is not null)) s from c)
select claim_id, claim, list_transform(list_filter(s, lambda x, i: len(list_filter(s, lambda y, j: j < i and contains(y.f, x.f) and y.f <> x.f)) = 0), lambda x: x.f) actions from s
"""


@register(f"select claim_id, array_to_string(actions, '|') forms from ({FORMS_SQL})")
def claim_surface_forms(spark, sf_dir):
    return claims_view(spark, sf_dir).select("claim_id", F.array_join(C.surface_forms(F.col("claim")), "|").alias("forms"))


# ---- search queries --------------------------------------------------------


def q(text: str, purpose: str) -> str:
    return f"{{'q': {text}, 'p': '{purpose}'}}"


def quoted(*parts: str) -> str:
    return " || ' ' || ".join(f"'\"' || {p} || '\"'" for p in parts)


def if_(test: str, *items: str) -> str:
    return f"case when {test} then [{', '.join(items)}] else [] end"


def each(values: str, name: str, body: str) -> str:
    return f"list_transform({values}, lambda {name}: {body})"


KEY_WORDS = f"list_filter(regexp_extract_all(t, '[A-Za-z0-9%$.,]+'), lambda w: length(w) > 2 and not list_contains({listed(L.QUERY_STOPWORDS)}, trim(lower(w), '.,')))"
TARGETS = f"case when contains(lower(t), 'renamed') or contains(lower(t), 'changed name') then {UNIQUE.format('targets_all')} else [] end"
CANDIDATES = ", ".join((
    f"[{q(quoted('bare'), 'exact_claim')}, {q('bare', 'proposition')}]",
    if_("action is not null and n0 is not null", q("n0 || ' ' || action", "entity_action"), q(quoted("n0", "action"), "entity_action_quoted")),
    if_("action is not null and n1 is not null", q("n0 || ' ' || n1 || ' ' || action", "entity_action")),
    if_("e0 is null and len(key_words) >= 2", q("array_to_string(key_words[1:7], ' ')", "entity_action")),
    if_("len(proper) >= 2", q("'\"' || array_to_string(proper, '\" \"') || '\"'", "entity_relationship")),
    f"flatten({each('proper[1:2]', 'e', 'list_concat(' + each('preds[1:2]', 'p', q(quoted('e', 'p'), 'entity_predicate')) + ', ' + each('times[1:1]', 'x', q(chr(101) + " || ' ' || x", 'entity_temporal')) + ')')})",
    "case when e0 is not null then " + each("list_filter(preds[1:2], lambda p: lower(p) not in ('being', 'is', 'are', 'was', 'were'))", "p", q("e0 || ' ' || p", "entity_predicate")) + " else [] end",
    f"flatten(flatten({each('nums[1:2]', 'n', each('ents[1:2]', 'e', 'list_concat([' + q(chr(101) + " || ' ' || n", 'numerical_entity') + '], ' + if_('p0 is not null', q(chr(101) + " || ' ' || p0 || ' ' || n", 'numerical_full')) + ')'))}))",
    if_(f"{rx('t', L.RENAMING)} and e1 is not null", *(q(f"{quoted('e0', 'e1')} || ' {r}'", "proposition_verification") for r in ("renamed", "name change", "rename"))),
    f"flatten({each('targets', 'x', '[' + q(quoted('e0', 'x'), 'direct_relationship') + ', ' + q(chr(101) + "0 || ' renamed ' || x", 'name_change') + ']')})",
    if_("e0 is not null and p0 is not null", q(f"{quoted('e0', 'p0')} || ' (false OR denied OR debunked OR fact check)'", "contradiction_search")),
    if_("e0 is not null and claim_type = 'geopolitical'", q("e0 || ' official government policy'", "official_source"), q("e0 || ' announcement news'", "news_context")),
    if_("e0 is not null and claim_type = 'policy'", q("e0 || ' law policy bill congress'", "policy_context")),
    if_("e0 is not null", q("trim(e0 || ' ' || coalesce(action, p0, '')) || ' fact check verify'", "fact_check")),
))
PARTS_SQL = f"""
select f.claim_id, f.claim t, f.actions, string_split(nullif(d.entities, ''), '|') ents_all, string_split(nullif(d.numbers, ''), '|') nums_all, string_split(nullif(d.temporal, ''), '|') times_all,
  d.claim_type, d.words, d.numbers, d.temporal, string_split(nullif(p.predicates, ''), '|') preds_all
from ({FORMS_SQL}) f join ({DECOMPOSED_SQL}) d using (claim_id) join ({PREDICATE_SQL}) p using (claim_id)
"""
QUERIES_SQL = f"""
with parts as (select *, coalesce(ents_all, []) ents, coalesce(nums_all, []) nums, coalesce(times_all, []) times, coalesce(preds_all, []) preds from ({PARTS_SQL})),
a as (select *, regexp_replace(trim(t), '[.!?]+$', '') bare, actions[1] as action, list_filter(ents[1:2], lambda e: length(trim(e)) > 2) named, {KEY_WORDS} key_words,
    list_filter(ents[1:3], lambda e: length(trim(e)) > 2 and lower(e) not in ('the', 'water', 'earth', 'c')) proper, ents[1] e0, ents[2] e1, preds[1] p0,
    flatten(list_transform(ents, lambda e: regexp_extract_all(t, '(?i)' || e || '\\s+(?:to|into|as)\\s+(\\w+(?:\\s+\\w+)?)', 1))) targets_all from parts),
b as (select *, named[1] n0, named[2] n1, {TARGETS} targets from a),
g as (select claim_id, flatten([{CANDIDATES}]) every from b),
u as (select claim_id, unnest(every) x, unnest(range(1, len(every) + 1)) i from g),
k as (select claim_id, x.q as query, x.p as purpose, i, row_number() over (partition by claim_id, lower(trim(x.q)) order by i) n from u),
r as (select claim_id, query, purpose, row_number() over (partition by claim_id order by case purpose {" ".join(f"when '{p}' then {r}" for p, r in L.PURPOSE_RANK.items())} else 50 end, i) rank from k where n = 1 and trim(query) <> '')
select claim_id, rank::int rank, query, purpose from r where rank <= 12
"""


@register(QUERIES_SQL)
def claim_queries(spark, sf_dir):
    return S.generate_queries(claims_view(spark, sf_dir))


@register(f"select claim_id, rank, query from ({QUERIES_SQL})")
def claim_query_variants(spark, sf_dir):
    return S.query_variants(claims_view(spark, sf_dir))


# ---- quantities ------------------------------------------------------------

SKIPPED = sorted({*L.PASSAGE_STOPWORDS, *L.MAGNITUDES, *L.CURRENCY_WORDS, *L.NOT_ATTRIBUTES})
TOKEN = "[a-z0-9$£€%.,]+"
QUANTITIES_SQL = f"""
with c as (select claim_id, lower(claim) low from ({CLAIMS_SQL})),
m as (select *, regexp_extract_all(low, {sql_text("(?i)" + L.QUANTITY)}) ms, string_split_regex(low, {sql_text("(?i)" + L.QUANTITY)}) rest, regexp_extract_all(low, '{TOKEN}') toks from c),
u as (select *, unnest(ms) m, unnest(range(1, len(ms) + 1)) i from m),
x as (select *, regexp_extract(m, {sql_text("(?i)" + L.QUANTITY)}, ['symbol', 'number', 'magnitude', 'unit']) g,
    coalesce(list_sum(list_transform(rest[1:i], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda s: length(s))), 0) pos from u),
y as (select *, greatest(0, len(regexp_extract_all(low[1:pos + 1], '{TOKEN}')) - 1) centre from x)
select claim_id, cast(replace(g.number, ',', '') as double) * case g.magnitude {" ".join(f"when '{k}' then {v!r}" for k, v in L.MAGNITUDES.items())} else 1.0 end as "value",
  case when g.unit = '%' or g.unit like 'percent%' then 'percent' when g.symbol <> '' or g.unit in ({listed(L.CURRENCY_WORDS)[1:-1]}) then 'currency' else 'count' end kind,
  array_to_string(list_sort(list_distinct(list_filter(toks[greatest(1, centre - 3)::bigint : (centre + 5)::bigint], lambda w: length(w) > 2 and not list_contains({listed(SKIPPED)}, w) and not regexp_matches(w, '[0-9]')))), ' ') attribute,
  trim(m) quantity
from y
"""


@register(QUANTITIES_SQL)
def claim_quantities(spark, sf_dir):
    rows = exploded(claims_view(spark, sf_dir), ["claim_id"], Q.quantities(F.col("claim")), "q")
    return rows.select("claim_id", "q.value", "q.kind", F.array_join("q.attribute", " ").alias("attribute"), F.col("q.text").alias("quantity"))


# ---- relevance -------------------------------------------------------------


def keywords(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '\\b([a-z]+(?:[a-z\\-]*[a-z])?)\\b', 1), lambda w: length(w) > 2 and not list_contains({listed(L.RELEVANCE_STOPWORDS)}, w)))"


DEMONYMS = " ".join(f"when {sql_text(k)} then {sql_text('|' + '|'.join(rf'\b{d}\b' for d in v))}" for k, v in L.DEMONYMS.items())
ENTITY_PATTERN = (
    r"case e when 'united states' then '(?i:\bunited states\b|\bamerica(?:ns?|s)?\b)|\b(?:U\.?S\.?A?\.?|USA)\b' when 'united kingdom' then '(?i:\bunited kingdom\b|\bbritain\b|\bbritish\b)|\b(?:U\.?K\.?)\b' "
    rf"when 'the great wall' then '(?i)\bgreat wall\b' else '(?i)(?:\b' || e || case when length(e) >= 4 and not contains(e, ' ') then {sql_text(L.COUNTRY_SUFFIX)} else '' end || '\b' || case e {DEMONYMS} else '' end || ')' end"
)
DOC_ENTITIES = (
    f"list_distinct(list_concat(list_transform(list_filter(regexp_extract_all(scanned, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1), lambda e: not list_contains({listed(L.NON_DOCUMENT_ENTITIES)}, e)), lambda e: lower(e)), "
    f"list_filter([{', '.join(f'case when {rx("scanned", chr(92) + "b" + p + chr(92) + "b")} then {sql_text(p)} end' for p in L.DOCUMENT_ENTITIES)}, "
    f"{', '.join(f'case when {rx("scanned", p, "")} then {sql_text(n)} end' for p, n in L.SHORT_ENTITIES)}], lambda e: e is not null)))"
)
SHARE = "case when len({0}) = 0 then 0.5e0 else len({1})::double / len({0}) end"
RELEVANCE_SQL = f"""
with parts as (select *, coalesce(ents_all, []) ents, coalesce(preds_all, []) preds from ({PARTS_SQL})),
e as (select claim_id, {EVENT_LIST} events, claim from ({CLAIMS_SQL})),
a as (select p.*, e.events, list_distinct(list_concat(e.events, list_filter(list_transform(e.events, lambda e: {OPPOSITE_CASE}), lambda x: x is not null))) wanted, {keywords("t")} kws,
    list_distinct(list_transform(ents, lambda e: lower(e))) es,
    list_filter(flatten(list_transform(preds, lambda p: string_split_regex(lower(p), '\\s+'))), lambda x: x not in ('being', 'is', 'are', 'was', 'were', 'to')) spoken,
    case when len(ents) = 1 then string_split(lower(ents[1]), ' ') else [] end lone,
    list_transform(list_concat(coalesce(nums_all, []), coalesce(times_all, [])), lambda x: lower(x)) generic from parts p join e using (claim_id)),
c as (select *, list_filter(list_distinct(list_concat(spoken, string_split(words, '|'))), lambda w: w <> '' and not list_contains(lone, w)) subject, list_transform(es, lambda e: {ENTITY_PATTERN}) patterns from a),
b as (select *, list_filter(subject, lambda w: not list_contains({listed(R.TIME_WORDS)}, w)) predwords from c),
d as (select o_orderkey doc_id, o_orderkey // 8 block, claim title, claim || ' More was reported by the BBC.' body from ({CLAIMS_SQL.replace("o_orderkey as claim_id", "o_orderkey, o_orderkey as claim_id")})),
f as (select doc_id, block, title || '  ' || body[1:{R.SCORED_CHARS}] combined, title || ' ' || body[1:{R.ENTITY_CHARS}] scanned, title claim from d),
g as (select *, lower(combined) low, {keywords("combined")} dk, len({DOC_ENTITIES}) n_entities, {EVENT_LIST.replace("lower(claim)", "lower(combined)")} devents from f),
x as (select b.*, g.doc_id, g.low, g.dk, g.n_entities, list_has_any(wanted, devents) acts, list_filter(patterns, lambda p: regexp_matches(combined, p)) hits, len(list_intersect(subject, dk)) overlap,
    list_intersect(predwords, dk) predhits, list_intersect(kws, dk) kwhits from b join g on g.block = b.claim_id // 8),
s as (select claim_id, doc_id, events, {SHARE.format("patterns", "hits")} entity, case when len(events) = 0 then 0.5e0 when acts then 1e0 else 0e0 end as action, {SHARE.format("predwords", "predhits")} predicate,
    case when overlap > 1 then case when n_entities > 0 then 0.7e0 else 0.55e0 end when n_entities > 0 then 0.4e0 else 0.2e0 end coherence,
    greatest(0e0, least(1e0, {SHARE.format("kws", "kwhits")} - 0.15e0 * len(list_filter(generic, lambda w: contains(low, w))))) specificity from x),
r as (select *, entity * {R.WEIGHTS[0]}e0 + action * {R.WEIGHTS[1]}e0 + predicate * {R.WEIGHTS[2]}e0 + coherence * {R.WEIGHTS[3]}e0 + specificity * {R.WEIGHTS[4]}e0 relevance from s)
select claim_id, doc_id, round(entity, 6) entity, round(action, 6) as action, round(predicate, 6) predicate, round(coherence, 6) coherence, round(specificity, 6) specificity, round(relevance, 6) relevance,
  not (relevance < {R.LEAST_STRICT}e0 or (len(events) > 0 and action = 0) or (entity = 0 and specificity < 0.35e0) or (entity < 0.5e0 and predicate < 0.5e0) or (predicate < 0.25e0 and action < 1)) included,
  array_to_string(list_filter([case when entity > 0.5e0 then {sql_text(L.RELEVANT[0])} end, case when predicate > 0.4e0 then {sql_text(L.RELEVANT[1])} end, case when coherence > 0.5e0 then {sql_text(L.RELEVANT[2])} end,
    case when len(events) > 0 and action >= 1 then {sql_text(L.RELEVANT[3])} end], lambda w: w is not null), '; ') reasons_included,
  array_to_string(list_filter([case when entity < {R.LEAST_ENTITY}e0 then {sql_text(L.IRRELEVANT[0])} end, case when len(events) > 0 and action = 0 then {sql_text(L.IRRELEVANT[1])} end, case when relevance < {R.LEAST:.2f}e0 then {sql_text(L.IRRELEVANT[2])} end,
    case when specificity < 0.2e0 then {sql_text(L.IRRELEVANT[3])} end], lambda w: w is not null), '; ') reasons_excluded
from r
"""
MEASURES = ("entity", "action", "predicate", "coherence", "specificity", "relevance")


def scored_blocks(spark, sf_dir):
    """Every claim against the texts of its block of eight order keys, which stand for its search results."""
    claims = R.claim_features(claims_view(spark, sf_dir)).withColumn("block", F.expr("claim_id div 8"))
    docs = claims_view(spark, sf_dir).select(F.expr("claim_id div 8").alias("block"), F.col("claim_id").alias("doc_id"), F.col("claim").alias("title"), F.lit("").alias("snippet"), F.concat("claim", F.lit(" More was reported by the BBC.")).alias("text"))
    return R.score_pairs(claims.join(R.document_features(docs), "block"))


@register(RELEVANCE_SQL)
def relevant_documents(spark, sf_dir):
    yes, no = R.reasons()
    return scored_blocks(spark, sf_dir).select("claim_id", "doc_id", *(F.round(c, 6).alias(c) for c in MEASURES), R.included().alias("included"), F.array_join(yes, "; ").alias("reasons_included"), F.array_join(no, "; ").alias("reasons_excluded"))


@register(f"select claim_id, doc_id, relevance, row_number() over (partition by claim_id order by relevance desc, doc_id)::int place from ({RELEVANCE_SQL})")
def relevance_order(spark, sf_dir):
    scored = scored_blocks(spark, sf_dir).withColumn("relevance", F.round("relevance", 6)).withColumn("ord", F.col("doc_id"))
    return R.by_relevance(scored).select("claim_id", "doc_id", "relevance", "place")


# ---- passages --------------------------------------------------------------


def content(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) > 2 and not list_contains({listed(L.PASSAGE_STOPWORDS)}, w)))"


STOCK = sql_text("|".join(p.replace(".", chr(92) + ".") for p in L.BOILERPLATE))
PASSAGES_SQL = f"""
with {SENTENCES_SQL[SENTENCES_SQL.index("d as ("):SENTENCES_SQL.index("select doc_id, len(s)")].rstrip()},
a as (select doc_id, text, list_transform(s, lambda x: trim(replace(x, chr(1), '.'))) s, {content("right(text, 200)")} asked from p),
r as (select doc_id, text, asked, list_sort(list_transform(s, lambda x, i: {{'n': -len(list_intersect({content("x")}, asked)), 'i': i, 's': x}})) r from a),
e as (select doc_id, list_concat([regexp_extract(text, '^([^\\n]*)', 1), ''], list_filter(list_transform(r, lambda x: x.s), lambda s: not (regexp_matches(lower(s), {STOCK}) and not list_has_any({content("s")}, asked)))) every from r),
u as (select doc_id, unnest(every) passage, unnest(range(1, len(every) + 1)) i from e),
k as (select *, trim(regexp_replace(lower(passage), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+', ' ', 'g')) key from u),
n as (select *, row_number() over (partition by doc_id, key order by i) nth from k where key <> ''),
o as (select doc_id, passage, (row_number() over (partition by doc_id order by i) - 1)::int passage_ord from n where nth = 1)
select doc_id claim_id, doc_id, passage_ord, passage from o where passage_ord < 8
"""


@register(PASSAGES_SQL)
def document_passages(spark, sf_dir):
    """Passages of each document for a claim: its own last 200 characters stand for one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"), F.lit("").alias("snippet"))
    return P.extract_passages(docs.withColumn("claim_id", F.col("doc_id")).withColumn("claim", F.substring("text", -200, 200)))


# ---- evaluation ------------------------------------------------------------


@register(f"with s as (select count(*) n from ({SCORES_SQL})), f as (select unnest(range(5))::int fold) select fold, n // 5 + case when fold < n % 5 then 1 else 0 end n from s, f")
def fold_sizes(spark, sf_dir):
    return V.folds(scores_view(spark, sf_dir)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register(f"""
with b as (select least(9, floor(p * 10 + 1e-12))::int bin, count(*) n, abs(avg(p) - avg(y)) gap from ({SCORES_SQL}) group by 1)
select round(sum(n * gap) / sum(n), 9) ece from b
""")
def calibration_error(spark, sf_dir):
    return V.calibration_error(scores_view(spark, sf_dir)).withColumn("ece", F.round("ece", 9))


@register()
def paired_interval(spark, sf_dir):
    """The gain of scores that are moved up by a tenth over those that aren't."""
    return V.paired_bootstrap(scores_view(spark, sf_dir).withColumn("q", F.col("p") + 0.1))


GUESSES = "select lang truth, case when n_chars % 5 = 0 then 'en' else lang end guess from documents"
CLASSES_SQL = f"""
with s as ({GUESSES}), l as (select distinct truth label from s union select distinct guess from s),
c as (select label, count(*) filter (truth = label) support, count(*) filter (guess = label) guessed, count(*) filter (truth = label and guess = label) tp from l, s group by 1)
select *, coalesce(tp / nullif(guessed, 0), 0) p, coalesce(tp / nullif(support, 0), 0) r, 2 * tp / (support + guessed) f from c
"""


def guesses_view(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("truth"), F.when(F.col("n_chars") % 5 == 0, "en").otherwise(F.col("lang")).alias("guess"))


@register(f'select round(sum(p * support) / sum(support), 9) as "precision", round(sum(r * support) / sum(support), 9) recall, round(sum(f * support) / sum(support), 9) f1, sum(support)::bigint support from ({CLASSES_SQL})')
def weighted_metrics(spark, sf_dir):
    return V.weighted(V.multiclass(guesses_view(spark, sf_dir))).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@register(f"with c as (select truth, guess, count(*) n from ({GUESSES}) group by 1, 2) select *, round(n / sum(n) over (), 9) share, round(n / max(n) over (), 9) intensity from c")
def confusion_shares(spark, sf_dir):
    return V.confusion_shares(guesses_view(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("share", "intensity")})


@register(f"select truth as label, count(*) n, round(avg(case when truth = guess then 1e0 else 0 end), 9) accuracy from ({GUESSES}) group by 1")
def label_accuracy(spark, sf_dir):
    return V.accuracy_by_label(guesses_view(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


SIX = "case n_chars % 7 when 0 then 'pants-fire' when 1 then 'false' when 2 then 'barely-true' when 3 then 'half-true' when 4 then 'mostly-true' when 5 then 'none' else 'false' end"


@register(f"""
with l(place, label) as (values {", ".join(f"({i}, '{x}')" for i, x in enumerate(L.SIX_LABELS))}), d as (select {SIX} label, count(*) n from documents group by 1)
select place, label, coalesce(n, 0) n from l left join d using (label)
""")
def label_counts(spark, sf_dir):
    from factloom.operators import models as M

    rows = table(spark, sf_dir, "documents").select(F.expr(SIX).alias("label")).filter(M.labels_to_numbers(F.col("label")).isNotNull())
    return V.label_distribution(rows, L.SIX_LABELS)


@register(f"select greatest(avg(y), 1 - avg(y)) baseline from ({SCORES_SQL})")
def majority_baseline(spark, sf_dir):
    return V.majority_baseline(scores_view(spark, sf_dir))


@register(f"""
with m as (select case when lang < 'f' then 'a' else 'b' end as model, avg(n_chars) x, count(*)::double y from documents group by 1),
l as (select model, 'x' metric, x v from m union all select model, 'y', y from m), b as (select metric, max(v) best from l group by 1)
select b.metric, round(best, 6) best, list_aggregate(list_sort(list(model)), 'string_agg', ',') models from b join l on l.metric = b.metric and v = best group by 1, 2
""")
def best_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.when(F.col("lang") < "f", "a").otherwise("b").alias("model")).agg(F.avg("n_chars").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return V.best_values(rows, ("x", "y")).select("metric", F.round("best", 6).alias("best"), F.array_join("models", ",").alias("models"))


@register()
def assessment(spark, sf_dir):
    return V.assessment(scores_view(spark, sf_dir))


# ---- reports ---------------------------------------------------------------


@register(f"""
select ord, claim_id, case when greatest(support, contradiction) > 0.7 then 'Strong' when greatest(support, contradiction) > 0.4 then 'Moderate' else 'Weak' end as label,
  case when support >= contradiction then 'supports' else 'contradicts' end direction, nli_available and {"(" + "case when support > 0.35e0 and contradiction > 0.35e0 then support >= contradiction * 1.6e0 or contradiction >= support * 1.6e0 else support > 0.35e0 or contradiction > 0.35e0 end" + ")"} is_evidence,
  floor((support - contradiction + 1) / 2 * 100 + 0.5)::int as direction_percent, case when support * 100 < 25 then 0 when support * 100 < 40 then 1 when support * 100 < 60 then 2 when support * 100 < 75 then 3 else 4 end band
from ({EVIDENCE_SQL})
""")
def evidence_cards(spark, sf_dir):
    s, c = F.col("support"), F.col("contradiction")
    label, percent = W.strength_label(s, c), W.percentages(s - c, s)
    return evidence_view(spark, sf_dir).select(
        "ord", "claim_id", label["label"].alias("label"), label["direction"].alias("direction"), W.addresses(F.col("stance"), F.col("nli_available")).alias("is_evidence"),
        percent["direction"].alias("direction_percent"), W.colour_band(s * 100).alias("band"),
    )


ERRORS = (
    "event_id", "case event_id % 3 when 0 then 'http' when 1 then 'network' else case when event_id % 2 = 0 then 'payload' else 'KeyError' end end as kind",
    "case event_id % 4 when 0 then 401 when 1 then 429 when 2 then 500 else 403 end as code",
    "case event_id % 7 when 0 then 'timed out' when 1 then 'Tunnel connection failed: 403' when 2 then 'Name or service not known' when 3 then 'CERTIFICATE verify failed' when 4 then 'reset' else '' end as message",
)
D = {k: sql_text(v) for k, v in L.DIAGNOSES.items()}
DIAGNOSIS_SQL = f"""
with e as (select {", ".join(ERRORS)} from events)
select event_id, case when kind = 'http' then case when code in (401, 403) then replace({D["rejected"]}, '%s', code::varchar) when code = 429 then {D["limited"]} else 'HTTP ' || code || ' — ' || message end
  when kind = 'network' then case when contains(message, 'timed out') then {D["timeout"]} when contains(message, 'CONNECT') or contains(message, 'Tunnel') or contains(message, '403') then {D["proxy"]}
    when contains(message, 'Name or service not known') then {D["dns"]} when contains(lower(message), 'certificate') then {D["tls"]} else 'network error — ' || message end
  when kind = 'payload' then 'provider returned an error — ' || message else kind || ' — ' || message end diagnosis
from e
"""


@register(DIAGNOSIS_SQL)
def provider_diagnoses(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*ERRORS).select("event_id", W.diagnosis(F.col("code"), F.col("kind"), F.col("message")).alias("diagnosis"))


@register("with o(outcome, k) as (values ('ok', 0), ('failed', 1), ('skipped', 2)), e as (select event_id % 7 // 3 k, count(*) n from events group by 1) select outcome, coalesce(n, 0) n from o left join e using (k)")
def provider_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.element_at(F.array(F.lit("ok"), F.lit("failed"), F.lit("skipped")), (F.expr("event_id % 7 div 3") + 1).cast("int")).alias("outcome"))
    return W.provider_tally(rows)


STANCE_LABELS = "case event_id % 6 when 0 then 'ENTAILMENT' when 1 then 'contradiction ' when 2 then 'LABEL_0' when 3 then 'label 2' when 4 then 'LABEL_9' else 'x-neutral' end as label"


@register(f"""
with e as (select event_id, {STANCE_LABELS}, case event_id % 2 when 0 then 'known' else 'other' end as model from events)
select event_id, case when lower(label) like '%entail%' then 'entailment' when lower(label) like '%contradict%' then 'contradiction' when lower(label) like '%neutral%' then 'neutral'
  when model = 'known' and replace(lower(trim(label)), ' ', '_') = 'label_0' then 'contradiction' when model = 'known' and replace(lower(trim(label)), ' ', '_') = 'label_2' then 'neutral' end stance from e
""")
def stance_names(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", STANCE_LABELS, "case event_id % 2 when 0 then 'known' else 'other' end as model")
    return rows.select("event_id", W.stance_name(F.col("label"), F.col("model"), {"known": ("contradiction", "entailment", "neutral")}).alias("stance"))


@register("""
with j as (select event_id, case event_id % 3 when 0 then 'success' when 1 then 'no_results' else 'failed' end status, event_id % 5 results, event_id % 60 elapsed from events)
select event_id, case when status <> 'failed' and elapsed > 45 then 'timeout' else status end status, case when status <> 'failed' and elapsed > 45 then 0 else results end results from j
""")
def search_timeouts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "case event_id % 3 when 0 then 'success' when 1 then 'no_results' else 'failed' end as status", "event_id % 5 as results", "event_id % 60 as elapsed")
    return W.expired(rows, F.col("elapsed"), F.lit(45)).select("event_id", "status", "results")


STATES = ("supported", "contradicted", "mixed", "unsupported_no_coverage", "reported_plan", "not_verifiable_yet", "insufficient_evidence", "not_a_claim")
REASONED = (
    "event_id", "case event_id % 8 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(STATES)) + " end as status", "event_id % 9 <> 0 as searched", "cast(event_id % 4 as int) as candidates", "cast(event_id % 3 as int) as relevant",
    "cast(event_id % 2 as int) as classified", "cast(event_id % 5 as int) as independent", "case event_id % 10 when 0 then 'SEARCH_FAILED' else 'SEARCH_SUCCESS' end as retrieval", "case event_id % 11 when 0 then 'failed' else 'ready' end as model_status",
    "'Because.' as reason", "event_id % 2 = 0 as prospective",
)
Y = {k: sql_text(v) for k, v in L.REASONING.items()}


def filled(text: str, *values: str) -> str:
    """A fixed text with its places filled in order."""
    parts = text.replace("%d", "%s").split("%s")
    return " || ".join(x for pair in zip(map(sql_text, parts), (*values, "''"), strict=True) for x in pair)


REASONING_SQL = f"""
with r as (select {", ".join(REASONED)} from events),
s as (select *, {filled(L.REASONING["searched"], "candidates", "case when candidates = 1 then '' else 's' end")} || case when relevant > 0 then {filled(L.REASONING["compared"], "relevant", "classified", "case when classified = 1 then 'was' else 'were' end")} else '' end || '.' scope from r)
select event_id, case when not searched then reason when retrieval = 'SEARCH_FAILED' then {Y["search_failed"]} else scope || case
  when model_status <> 'ready' and status <> 'not_a_claim' then {filled(L.REASONING["no_model"], "model_status")}
  when status = 'unsupported_no_coverage' then {filled(L.REASONING["no_coverage"], "case when prospective then 'A plan' else 'An event' end")}
  when status = 'reported_plan' then {Y["reported_plan"]} when status = 'not_verifiable_yet' then {filled(L.REASONING["not_verifiable_yet"], "reason")}
  when status in ('supported', 'contradicted', 'mixed') then {filled(L.REASONING["direction"], "case when independent > 0 then " + filled(L.REASONING["publishers"], "independent", "case when independent = 1 then '' else 's' end") + " else '' end", "case status when 'supported' then 'support' when 'contradicted' then 'contradict' else 'point both ways on' end")}
  when relevant = 0 and candidates > 0 then {Y["nothing_relevant"]} else {Y["nothing_strong"]} end end reasoning from s
"""


@register(REASONING_SQL)
def verdict_reasoning(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "events").selectExpr(*REASONED)
    return rows.select("event_id", W.reasoning(c("reason"), c("prospective"), c("status"), c("searched"), c("candidates"), c("relevant"), c("classified"), c("independent"), c("retrieval"), c("model_status")).alias("reasoning"))


@register("select o_orderkey check_id, o_custkey user_id, c_name as name from orders join customer on c_custkey = o_custkey")
def checks_with_users(spark, sf_dir):
    from factloom.sources import history

    checks = table(spark, sf_dir, "orders").selectExpr("o_orderkey as check_id", "o_custkey as user_id")
    users = table(spark, sf_dir, "customer").selectExpr("c_custkey as user_id", "c_name as name")
    return history.with_owner(checks, users)


# ---- providers -------------------------------------------------------------

#: Items of made-up provider pages, a page for each customer; both dialects.
KEY = "cast(o_orderkey as varchar(20))"
ITEMS = (
    "o_custkey as page", "o_orderkey as k", f"case when o_orderkey % 13 = 0 then '' else concat('https://news.example/', {KEY}) end as url",
    f"case when o_orderkey % 17 = 0 then '' else concat('Story ', {KEY}) end as title", f"concat('About ', {KEY}, case o_orderkey % 3 when 0 then ' [+12 chars]' when 1 then '…' else ' […] ' end) as about",
    f"case when o_orderkey % 2 = 0 then concat('A longer body of story ', {KEY}, '… [+9 chars]') else '' end as body", "o_orderdate as t", "concat('Desk ', cast(o_orderkey % 5 as varchar(20))) as desk",
)
ITEMS_SQL = f"select *, (row_number() over (partition by page order by k) - 1)::int ord, strftime(t, '%Y-%m-%d') dated from (select {', '.join(ITEMS)} from orders)"


def pages_of(spark, sf_dir, item, before: str, after: str, glue: str, text=None):
    """page and payload: each customer's items in order of key, each the text ``item`` or what ``text`` makes of it.

    Orders are dealt, not texts, into a fixed number of parts: by the few bytes
    that equal texts are shuffled as, Spark would leave parsing to few tasks.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, sf_dir, "orders").repartition(parts, "o_custkey").selectExpr(*ITEMS)
    listed_items = F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("one")))), lambda x: text(x["one"]) if text else x["one"])
    return rows.groupBy("page").agg(F.concat(F.lit(before), F.array_join(listed_items, glue), F.lit(after)).alias("payload"))


def plain(rows, *columns):
    return rows.select("page", "ord", *columns, F.col("published").cast("timestamp_ntz").alias("published"))


def iso():
    return F.date_format("t", "yyyy-MM-dd'T'00:00:00'Z'")


@register(f"""
with i as ({ITEMS_SQL}), x as (select *, 'About ' || k || case when k % 3 = 1 then '' else '' end about_clean, case when body = '' then '' else 'A longer body of story ' || k || '…' end body_clean from i)
select page, ord, url, title, case when length(body_clean) > length(about_clean) then body_clean else about_clean end snippet, desk as source, 'newsapi' as provider, dated::timestamp published
from x where page % 7 <> 0 and url <> '' and title <> ''
""")
def news_payloads(spark, sf_dir):
    from factloom.sources import payloads

    item = F.to_json(F.struct("url", "title", F.col("about").alias("description"), F.col("body").alias("content"), iso().alias("publishedAt"), F.struct(F.col("desk").alias("name")).alias("source")))
    pages = pages_of(spark, sf_dir, item, '{"articles":[', "]}", ",")
    refused = F.concat(F.lit('{"status":"error",'), F.substring("payload", 2, 1 << 30))
    return plain(payloads.news_items(pages.withColumn("payload", F.when(F.col("page") % 7 == 0, refused).otherwise(F.col("payload"))), "newsapi"), "url", "title", "snippet", "source", "provider")


@register(f"""
with i as ({ITEMS_SQL}), x as (select *, (row_number() over (partition by page order by dated desc, ord) - 1)::int place from i where url <> '' and title <> '' and dated >= '1997-01-01')
select page, place as ord, url, dated::timestamp published from x
""")
def dated_payloads(spark, sf_dir):
    """News limited to what was published since a day, the newest first."""
    from factloom.sources import payloads

    item = F.to_json(F.struct("url", "title", iso().alias("publishedAt")))
    return plain(payloads.news_items(pages_of(spark, sf_dir, item, '{"articles":[', "]}", ","), "newsapi", F.lit("1997-01-01").cast("timestamp")), "url")


@register(f"""
with i as ({ITEMS_SQL})
select page, ord, url, case when k % 2 = 0 then 'Headline ' || k else title end title, 'Trail of ' || k as snippet, body as text, 'guardian' as provider, 'The Guardian' as source, dated::timestamp published
from i where url <> '' and (title <> '' or k % 2 = 0)
""")
def full_text_payloads(spark, sf_dir):
    from factloom.sources import payloads

    fields = F.struct(
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("Headline "), F.col("k").cast("string"))).alias("headline"), F.concat(F.lit("<p>Trail  of <b>"), F.col("k").cast("string"), F.lit("</b></p>")).alias("trailText"), F.col("body").alias("bodyText"),
    )
    item = F.to_json(F.struct(F.col("url").alias("webUrl"), F.col("title").alias("webTitle"), iso().alias("webPublicationDate"), fields.alias("fields")))
    return plain(payloads.full_text_items(pages_of(spark, sf_dir, item, '{"response":{"results":[', "]}}", ",")), "url", "title", "snippet", "text", "provider", "source")


@register(f"""
with i as ({ITEMS_SQL})
select page, ord, 'https://en.wikipedia.org/wiki/' || replace(title, ' ', '_') url, title, 'Rate of ' || k as snippet, 'wikipedia' as provider, 'Wikipedia' as source, null::timestamp published from i where ord < 3
""")
def encyclopaedia_payloads(spark, sf_dir):
    from factloom.sources import payloads

    item = F.to_json(F.struct("title", F.concat(F.lit('<span class="m">Rate</span>  of '), F.col("k").cast("string")).alias("snippet")))
    return plain(payloads.encyclopaedia_items(pages_of(spark, sf_dir, item, '{"query":{"search":[', "]}}", ",")), "url", "title", "snippet", "provider", "source")


@register(f"""
with i as ({ITEMS_SQL})
select page, ord, 'https://www.Site' || (k % 4) || '.com/' || k as url, case k % 4 when 0 then 'Rates rise ' || k when 1 then 'Rates rise ' || k when 2 then 'Rates rise ' || k || ' - what the bank said, and why it matters now!' else 'Rates rise ' || k end title,
  'So it is ' || k as snippet, 'google_news' as provider, case k % 4 when 0 then 'BBC News' when 1 then 'The Times' when 2 then 'site2.com' else 'site3.com' end as source, dated::timestamp published
from i where ord < 5
""")
def feed_payloads(spark, sf_dir):
    """Feeds whose items name their publisher by an element, by the title's end, or by the link's host alone."""
    from factloom.sources import payloads

    k = F.col("k").cast("string")
    kind = F.col("k") % 4
    end = F.when(kind == 0, " - BBC News").when(kind == 1, " - The Times").when(kind == 2, " - what the bank said, and why it matters now!").otherwise("")
    item = F.concat(
        F.lit("<item><title>Rates rise "), k, end, F.lit("</title><link>https://www.Site"), kind.cast("string"), F.lit(".com/"), k, F.lit("</link><pubDate>"), F.date_format("t", "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT</pubDate>"),
        F.lit("<description>&lt;b&gt;So&lt;/b&gt;  it is "), k, F.lit("</description>"), F.when(kind == 0, "<source>BBC News</source>").otherwise(""), F.lit("</item>"),
    )
    # Two items at least: with one alone it is no array.
    blank = "<item><title>t</title><link>https://x.org/</link></item>"
    pages = pages_of(spark, sf_dir, item, "<rss><channel>", f"{blank * 6}</channel></rss>", "")
    return plain(payloads.feed_items(pages).filter("url <> 'https://x.org/'"), "url", "title", "snippet", "provider", "source")


@register(f"""
with i as ({ITEMS_SQL}), f as (select page, k // 2 * 2 as pair, min(ord) ord, min(k) k from i group by 1, 2), n as (select *, (row_number() over (partition by page order by ord) - 1)::int place from f)
select page, place as ord, 'https://a.com/' || pair as url, 'A story ' || k as title, 'about ' || k as snippet from n where place < 10
""")
def search_page_payloads(spark, sf_dir):
    """Search pages with redirecting links, every other one to the page of the link before it."""
    from factloom.sources import payloads

    def link(key):
        k, pair = key.cast("string"), (key - key % 2).cast("string")
        return F.concat(F.lit('<div><a class="x result__a" href="//d.com/l/?uddg=https%3A%2F%2Fa.com%2F'), pair, F.lit('">A <b>story</b> '), k, F.lit('</a><a class="result__snippet">about '), k, F.lit("</a></div>"))

    return payloads.search_page_items(pages_of(spark, sf_dir, F.col("k"), "<html>", "</html>", "", link)).select("page", "ord", "url", "title", "snippet")


REQUESTS = ("o_orderkey as k", "case o_orderkey % 6 when 0 then 'gnews' when 1 then 'guardian' when 2 then 'newsapi' when 3 then 'google_news' when 4 then 'wikipedia' else 'duckduckgo' end as provider", "case when o_orderkey % 2 = 0 then 7 end as days", "concat('(rates OR \"rise\") NOT ', cast(o_orderkey as varchar(20))) as query")


@register(f"""
with r as (select {", ".join(REQUESTS)} from orders)
select k, case when provider = 'google_news' and days is not null then query || ' when:' || days || 'd' else query end asked, case when provider = 'gnews' and days is not null then strftime(date '2024-06-01' - days, '%Y-%m-%dT00:00:00Z') when provider in ('guardian', 'newsapi') and days is not null then strftime(date '2024-06-01' - days, '%Y-%m-%d') end since,
  case when provider = 'newsapi' then case when days is null then 'relevancy' else 'publishedAt' end when provider = 'gnews' and days is not null then 'publishedAt' end sort, 'rates rise ' || k as plain from r
""")
def provider_requests(spark, sf_dir):
    from factloom.sources import payloads

    rows = table(spark, sf_dir, "orders").selectExpr(*REQUESTS).withColumn("r", S.request(F.col("provider"), F.col("query"), F.col("days"), F.lit("2024-06-01").cast("date")))
    return rows.select("k", F.col("r.query").alias("asked"), "r.since", "r.sort", payloads.plain_query(F.col("query")).alias("plain"))


def sentences(text: str) -> str:
    """The sentences of a text as in SENTENCES_SQL, for another column."""
    part = SENTENCES_SQL[SENTENCES_SQL.index("list_filter(string_split("):SENTENCES_SQL.index(" s from d)")]
    return part.replace("replace(t, ", f"replace(trim(regexp_replace({text}, '\\s+', ' ', 'g')), ", 1) if "replace(t, " in part else part


def left_over(text: str) -> str:
    """Words of a text without its stock sentences."""
    return f"coalesce(list_sum(list_transform(list_filter(list_transform({sentences(text)}, lambda x: trim(replace(x, chr(1), '.'))), lambda s: not (regexp_matches(lower(s), {STOCK}) and not list_has_any({content('s')}, asked))), lambda s: len(string_split(s, ' ')))), 0)"


@register(f"""
with d as (select doc_id, text as whole, left(text, 400) part, {content("right(text, 200)")} asked from documents where text is not null),
w as (select *, case when trim(regexp_replace(part, '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(part, '\\s+', ' ', 'g')), ' ')) end n, {left_over("whole")} n_whole, {left_over("part")} n_part from d)
select doc_id, n < 120 needs_fetch, whole <> '' and n_whole > n_part takes_fetched from w
""")
def article_choices(spark, sf_dir):
    """Whether the first 400 characters of a document would be fetched anew, and whether the whole would then stand."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", F.substring("text", 1, 400).alias("part"), F.substring("text", -200, 200).alias("claim"))
    chosen = P.choose_text(F.col("part"), F.concat("text", F.lit("\x01")), F.col("claim"))
    return rows.select("doc_id", P.needs_fetch(F.col("part")).alias("needs_fetch"), (chosen == F.concat("text", F.lit("\x01"))).alias("takes_fetched"))


# ---- models ----------------------------------------------------------------

HISTORY_ROWS = ("o_orderkey as doc_id", "case o_orderkey % 6 when 0 then 'pants-fire' when 1 then 'false' when 2 then 'barely-true' when 3 then 'half-true' when 4 then 'mostly-true' else 'true' end as label", *(
    f"cast(o_orderkey % {m} as int) as {c}" for m, c in ((3, "barely_true"), (4, "false"), (5, "half_true"), (7, "mostly_true"), (2, "pants_fire"))
))


@register(f"""
with r as (select {", ".join(HISTORY_ROWS).replace(" as false", ' as "false"')} from orders)
select doc_id, {", ".join(f"""round(ln(1 + greatest(0, "{c}" - case when label = '{lab}' then 1 else 0 end)), 9) h_{c}""" for lab, c in (("barely-true", "barely_true"), ("false", "false"), ("half-true", "half_true"), ("mostly-true", "mostly_true"), ("pants-fire", "pants_fire")))},
  case label when 'pants-fire' then 0 when 'false' then 1 when 'barely-true' then 2 when 'half-true' then 3 when 'mostly-true' then 4 else 5 end number, case when label in ('true', 'mostly-true', 'half-true') then 1e0 else 0e0 end as binary_label
from r
""")
def speaker_history(spark, sf_dir):
    from factloom.operators import models as M

    rows = table(spark, sf_dir, "orders").selectExpr(*(x.replace(" as false", " as `false`") for x in HISTORY_ROWS))
    counts = M.history_counts(rows)
    return counts.join(rows.select("doc_id", M.labels_to_numbers(F.col("label")).alias("number"), M.labels_to_binary(F.col("label")).alias("binary_label")), "doc_id").withColumns({c: F.round(c, 9) for c in counts.columns if c != "doc_id"})


@register(f"""
select doc_id, case when p >= 0.5 then 'True-ish' else 'Fake-ish' end as label,
  case when p < 0.2 then 'very likely incorrect' when p < 0.4 then 'probably incorrect' when p < 0.6 then 'uncertain or mixed' when p < 0.8 then 'probably correct' else 'very likely correct' end words, 0.5e0 threshold from ({SCORES_SQL})
""")
def named_scores(spark, sf_dir):
    from factloom.operators import models as M

    return M.named_statement(scores_view(spark, sf_dir)).select("doc_id", "label", "words", "threshold")


@register()
def linear_model(spark, sf_dir):
    """Out-of-fold scores of the linear model on labelled documents, fifty steps each."""
    from factloom.operators import models as M

    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    return M.out_of_fold(V.folds(rows, 2), 2, M.MODERN | {"epochs": 50})


# ---- the product query -----------------------------------------------------

NORMAL = f"select claim_id, normalised as claim from ({normalise_sql()})"
DOC_HOST = "case d.claim_id % 5 " + " ".join(f"when {i} then '{h}'" for i, h in enumerate(verdict.HOSTS)) + " end"
BODY = "case when a.doc_id is not null then '' else d.claim || '. More was reported on Monday, officials said.' end"
CAND = f"""select x.claim_id, d.claim_id % 4 job_order, d.claim_id ord, {DOC_HOST} || '/' || d.claim_id url, d.claim title, {BODY} body, e.ts published
from ({CLAIMS_SQL}) x join ({CLAIMS_SQL}) d on x.claim_id // 8 = d.claim_id // 8 left join documents a on a.doc_id = d.claim_id left join events e on e.event_id = d.claim_id"""
BLOCKS = RELEVANCE_SQL[RELEVANCE_SQL.index("d as (select o_orderkey doc_id"):RELEVANCE_SQL.index("f as (select doc_id, block")]
CANDIDATE_RELEVANCE = RELEVANCE_SQL.replace(BLOCKS, f"d as (select d.claim_id doc_id, d.claim_id // 8 block, d.claim title, {BODY} body from ({CLAIMS_SQL.replace('o_orderkey as claim_id', 'o_orderkey + 0 as claim_id')}) d left join documents a on a.doc_id = d.claim_id),\n").replace(CLAIMS_SQL, NORMAL)
CANDIDATE_DEDUP = DEDUP_SQL.replace(f"select {', '.join(RESULTS)} from orders", f"select claim_id, job_order, ord, url, title from ({CAND})")
DENIES = r"'\b(?:denied|denies|false|did not|never)\b'"
QUANTITY_ROWS = QUANTITIES_SQL.replace(f"select claim_id, lower(claim) low from ({CLAIMS_SQL})", "select {0} claim_id, lower({1}) low from {2}".replace("{0}", "@id").replace("{1}", "@text").replace("{2}", "@from"))


def quantity_rows(key: str, text: str, source: str) -> str:
    return QUANTITY_ROWS.replace("@id", key).replace("@text", text).replace("@from", source)


SAY = L.REASONING
JUDGED_CLAIMS_SQL = f"""
with cl as (
  select n.claim_id, n.normalised as claim, t.kind, t.claim_type, t.salience, t.negated, f.verdict fv, f.confidence fc, n.recent_label or m.m is not null recent,
    case when f.verdict is not null then 'rule' when not t.search_worthwhile then 'none' else 'search' end route
  from ({normalise_sql()}) n join ({TRIAGE_SQL.replace(CLAIMS_SQL, NORMAL)}) t using (claim_id) join (select claim_id, {MARKER_SQL} m from ({NORMAL})) m using (claim_id) left join ({FACTS_SQL.replace(CLAIMS_SQL, NORMAL)}) f using (claim_id)),
cand as ({CAND}),
sel as (
  select cl.claim_id, cl.claim, cl.recent, c.ord doc, c.url, c.title, c.body, c.published, {content("cl.claim")} asked
  from ({CANDIDATE_DEDUP}) k join cand c on c.claim_id = k.claim_id and c.ord = k.ord join ({CANDIDATE_RELEVANCE}) r on r.claim_id = k.claim_id and r.doc_id = k.ord and r.included join cl on cl.claim_id = k.claim_id where cl.route = 'search'),
fet as (select sel.*, coalesce(a.text, '') fetched from sel left join documents a on a.doc_id = sel.doc),
art as (select *, case when fetched <> '' and {left_over("fetched")} > {left_over("body")} then fetched else body end as text from fet),
sen as (select *, list_transform({sentences("text")}, lambda x: trim(replace(x, chr(1), '.'))) s from art),
rnk as (select *, list_sort(list_transform(s, lambda x, i: {{'n': -len(list_intersect({content("x")}, asked)), 'i': i, 's': x}})) r from sen),
evy as (select *, list_concat([title, ''], list_filter(list_transform(r, lambda x: x.s), lambda s: not (regexp_matches(lower(s), {STOCK}) and not list_has_any({content("s")}, asked)))) every from rnk),
uns as (select claim_id, doc, claim, asked, unnest(every) passage, unnest(range(1, len(every) + 1)) i from evy),
kys as (select *, trim(regexp_replace(lower(passage), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+', ' ', 'g')) key from uns),
nth as (select *, row_number() over (partition by claim_id, doc, key order by i) n from kys where key <> ''),
pas as (select *, row_number() over (partition by claim_id, doc order by i) p from nth where n = 1 qualify p <= 8),
mrk as (select *, len(list_intersect({content("passage")}, asked)) >= 0.6e0 * len(asked) near, regexp_matches(lower(passage), {DENIES}) and not regexp_matches(lower(claim), {DENIES}) denies, {rx("passage", L.REPORTING_FRAME)} frame from pas),
sco as (select claim_id, doc, coalesce(max(case when near and not denies then 0.93e0 else 0.04e0 end) filter (not frame), max(case when near and not denies then 0.93e0 else 0.04e0 end)) support, max(case when near and denies then 0.91e0 else 0.03e0 end) contradiction from mrk group by 1, 2),
cq as (select claim_id, row_number() over () q, "value" v, kind, list_filter(string_split(attribute, ' '), lambda x: x <> '') atts from ({quantity_rows("claim_id", "claim", "cl")})),
dq as (select claim_id // 1000000 claim_id, claim_id % 1000000 doc, "value" v, kind, list_filter(string_split(attribute, ' '), lambda x: x <> '') atts from ({quantity_rows("claim_id * 1000000 + doc", "body", "(select claim_id, doc, string_agg(passage, chr(10) order by p) body from pas group by 1, 2)")})),
cmp as (select cq.claim_id, dq.doc, q, bool_or(abs(cq.v - dq.v) <= 0.02e0 * greatest(abs(cq.v), abs(dq.v))) near from cq join dq on cq.claim_id = dq.claim_id and cq.kind = dq.kind and list_has_any(cq.atts, dq.atts) group by 1, 2, 3),
con as (select claim_id, doc, bool_or(not near) conflict from cmp group by 1, 2),
jud as (select s.*, sel.url, sel.recent and sel.published < timestamp '{verdict.NOW}' - interval 45 day old, coalesce(con.conflict, false) conflict, {STANCE} said from sco s join sel using (claim_id, doc) left join con using (claim_id, doc)),
evi as (select claim_id, url, '' publisher, case doc % 5 when 2 then 0e0 when 4 then 1e0 else 0.8e0 end source_weight, support, contradiction, true nli_available,
  case when said = 'supports' and (conflict or coalesce(old, false)) then 'unclear' else said end stance, said = 'supports' and not conflict and coalesce(old, false) stale from jud),
sta as ({CLAIM_STANCE_SQL.replace(f"({JUDGED_SQL})", "evi")}),
cnt as (select cand.claim_id, count(*) candidates, (select count(*) from sel where sel.claim_id = cand.claim_id) relevant from cand group by 1),
old as (select claim_id, count(*) filter (stale) stale from evi group by 1),
j as (
  select cl.*, case when cl.claim_id % 9 = 0 then false else true end answered, candidates, relevant, coalesce(old.stale, 0) stale, coalesce(sta.status, 'insufficient_evidence') st, coalesce(sta.net, 0e0) net, coalesce(sta.nli_available, false) ready,
    coalesce(evidence_count, 0) evidence_count, coalesce(supporting_count, 0) sc, coalesce(contradicting_count, 0) cc, coalesce(independent_supporting, 0) isup, coalesce(independent_contradicting, 0) icon
  from cl join cnt using (claim_id) left join sta using (claim_id) left join old using (claim_id)),
a as (select *, case when relevant = 0 then 'NO_RELEVANT_RESULTS' when answered then 'SEARCH_SUCCESS' else 'SEARCH_FAILED' end retrieval_status, kind = 'prospective' prospective from j),
b as (select *, route = 'search' and not negated and retrieval_status in ({listed(L.SEARCH_WORKED)[1:-1]}) and candidates >= 4 and answered and salience = 'high' and sc = 0 and cc = 0 and stale = 0 absent from a),
d as (select *, case when route = 'rule' then case fv when 'true' then 'supported' when 'false' then 'contradicted' else 'not_objectively_verifiable' end when route = 'none' then case when kind = 'opinion' then 'not_objectively_verifiable' else 'not_a_claim' end
  when absent then 'unsupported_no_coverage' when prospective and st = 'supported' then 'reported_plan' when prospective and st = 'insufficient_evidence' then 'not_verifiable_yet' else st end status from b),
i as (select *, case when status = 'contradicted' then icon when status = 'supported' then isup else greatest(isup, icon) end backing from d),
w as (select *, {filled(SAY["searched"], "candidates", "case when candidates = 1 then '' else 's' end")} || case when relevant > 0 then {filled(SAY["compared"], "relevant", "evidence_count", "case when evidence_count = 1 then 'was' else 'were' end")} else '' end || '.' scope from i)
select claim_id, claim, route, status, retrieval_status, evidence_count,
  case when absent and prospective then 'no credible source reports such a plan' else case status {" ".join(f"when {sql_text(k)} then {sql_text(v)}" for k, v in E.PHRASES.items())} end end verdict,
  coalesce(fc, case when status in ('not_a_claim', 'not_objectively_verifiable') then 'high' when status = 'unsupported_no_coverage' then case when candidates >= 15 then 'high' when candidates >= 8 then 'medium' else 'low' end
    when status in ('insufficient_evidence', 'not_verifiable_yet') or not ready then 'low' when backing >= 3 then 'high' when backing >= 2 then 'medium' else 'low' end) confidence,
  case when status in ({listed(E.NON_NUMERIC)[1:-1]}) then 50 else round_even(greatest(5e0, least(95e0, 50 + 45 * greatest(-1e0, least(1e0, net)))), 0)::int end balance,
  case when route <> 'search' then claim_type when retrieval_status = 'SEARCH_FAILED' then {sql_text(SAY["search_failed"])} else scope || case
    when status = 'unsupported_no_coverage' then {filled(SAY["no_coverage"], "case when prospective then 'A plan' else 'An event' end")}
    when status = 'reported_plan' then {sql_text(SAY["reported_plan"])} when status = 'not_verifiable_yet' then {filled(SAY["not_verifiable_yet"], "claim_type")}
    when status in ('supported', 'contradicted', 'mixed') then {filled(SAY["direction"], "case when backing > 0 then " + filled(SAY["publishers"], "backing", "case when backing = 1 then '' else 's' end") + " else '' end", "case status when 'supported' then 'support' when 'contradicted' then 'contradict' else 'point both ways on' end")}
    when relevant = 0 and candidates > 0 then {sql_text(SAY["nothing_relevant"])} else {sql_text(SAY["nothing_strong"])} end end reasoning
from w
"""


@register(JUDGED_CLAIMS_SQL)
def judged_claims(spark, sf_dir):
    """The flagship, claims to verdicts: candidates from a claim's block, texts of ``documents`` as the articles of some; a word scorer stands for the model."""
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return verdict.demonstration(claims_view(spark, sf_dir), articles, table(spark, sf_dir, "events"))


@register()
def checked_claims(spark, sf_dir):
    """The same with the articles read from ``pages``."""
    from factloom.sources import payloads

    articles = payloads.articles(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc"), "text")
    return verdict.demonstration(claims_view(spark, sf_dir), articles, table(spark, sf_dir, "events"))
