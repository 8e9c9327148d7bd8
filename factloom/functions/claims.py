"""Claim pre-processing as column expressions: normalising, splitting, triage, decomposition, time anchors, known facts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import lexicon as L
from factloom.functions.patterns import KEEP, any_of, collapse, find_all, has, let, swap, whole, words

# ---- normalising -----------------------------------------------------------


def compose(text: Column) -> Column:
    """Unicode compatibility composition; plain ASCII, nearly everything, skips the Python side's work."""
    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return nfkc(text)


def strip_emoji(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{So}\p{Sk}\p{Cs}\p{Cf}]", "")


def strip_quotes(text: Column) -> Column:
    inner = lambda t: F.trim(F.substring(t, F.lit(2), F.length(t) - 2))
    out = text
    for opening, closing in reversed(L.QUOTES):
        out = F.when((F.length(text) > 2) & text.startswith(opening) & text.endswith(closing), inner(text)).otherwise(out)
    return out


def leading_label(raw: Column) -> Column:
    """The wire label that a submission starts with, lower case; empty without one."""
    found = F.regexp_extract(F.trim(F.coalesce(raw, F.lit(""))), rf"(?iU)^\s*({L.LABEL})\s*[:\-–—]\s*", 1)
    return F.lower(F.regexp_replace(found, r"\s+", " "))


def signals_recency(raw: Column) -> Column:
    return leading_label(raw).isin(*L.RECENCY_LABELS)


def _frames(text: Column) -> Column:
    text = swap(text, rf"^\s*{L.LABEL}\s*[:\-–—]\s*", "")
    text = swap(text, rf"^\s*(?:{'|'.join(L.FRAMES)})\s*[:,]?\s+", "")
    return F.trim(swap(text, rf"\s*[,;:–—-]?\s*(?:{'|'.join(L.TAILS)})\s*[?.!]*\s*$", ""))


def normalize_claim(raw: Column, unicode: bool = True) -> Column:
    """A submission without its packaging; never empty unless the submission is. ``unicode=False`` keeps to JVM expressions."""
    start = F.trim(F.coalesce(raw, F.lit("")))
    text = strip_emoji(compose(start) if unicode else start)
    for pattern, new in ((L.URL, " "), (r"(?:^|\s)#\w+", " "), (r"(?:^|\s)@\w+", " "), (r"\s*\bvia\s+@?\w+\s*$", "")):
        text = swap(text, pattern, new)
    text = collapse(text)
    for _ in range(3):  # a pass that changes nothing is followed by passes that change nothing
        text = _frames(text)
    text = let(text, strip_quotes)
    text = F.trim(swap(text, L.ATTRIBUTION_TAIL, "", KEEP))
    text = let(text, strip_quotes)
    text = collapse(F.regexp_replace(text, r"([!?.])\1+", "$1"))
    text = F.btrim(text, F.lit(" ,;:-–—"))
    text = let(text, lambda t: F.when(t.endswith("?") & ~has(t, rf"^(?:{L.QUESTION_WORDS})\b"), F.trim(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t))
    return F.coalesce(F.nullif(text, F.lit("")), start)


# ---- sentences and claims --------------------------------------------------

_DOT = "․"  # stands for a full stop that ends no sentence


def protect(text: Column) -> Column:
    """Patterns begin with the full stop and look back from it, so most of a text is passed over by one comparison a character."""
    text = swap(text, rf"\.(?<=\b(?:{'|'.join(L.ABBREVIATIONS)})\.)", _DOT)
    for pair in L.DOTTED:
        first, second = pair.split(".")
        text = swap(text, rf"\.(?<=\b{first}\.)({second})\.", f"{_DOT}$1{_DOT}")
    return text


def restore(text: Column) -> Column:
    return F.replace(text, F.lit(_DOT), F.lit("."))


def word_total(text: Column) -> Column:
    return let(collapse(text), lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, " "))))


def split_sentences(text: Column, least: int = 5) -> Column:
    # All white space is single spaces here.
    parts = F.split(protect(collapse(text)), r" (?<=[.!?] )(?=[A-Z\"'(\[])")
    return F.transform(F.filter(parts, lambda s: (s != "") & (F.size(F.split(s, " ")) >= least)), lambda s: F.trim(restore(s)))


def distinct_by(values: Column, key) -> Column:
    """First of each key, in order; keys are sorted, so the work is no square of the number of values."""
    def firsts(v: Column) -> Column:
        keyed = F.array_sort(F.transform(v, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        starts = let(keyed, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"])))
        return F.transform(F.array_sort(F.transform(starts, lambda x: x["i"])), lambda i: F.get(v, i))

    return let(values, firsts)


def extract_claims(text: Column, most: int = 6, least_words: int = 4) -> Column:
    """The claims of a submission: its sentences, or the whole of it if any would be a fragment."""
    tidy = collapse(text)
    parts = F.filter(F.transform(F.split(protect(tidy), r"(?<=[.!?])\s+|;\s+"), lambda s: F.btrim(restore(s), F.lit(" -•\t"))), lambda s: s != "")
    return F.when(tidy == "", F.array().cast("array<string>")).otherwise(
        let(parts, lambda p: F.when(F.exists(p, lambda s: word_total(s) < least_words) | (F.size(p) == 0), F.array(tidy)).otherwise(F.slice(distinct_by(p, F.lower), 1, most)))
    )


# ---- triage ----------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9']+"), F.lit(0))


def looks_english(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    foreign = F.length(F.regexp_replace(text, "[^" + L.NON_LATIN[1:], ""))
    said = F.array_distinct(F.transform(tokens(text), F.lower))
    return ~(foreign > 0.3 * letters) & (F.arrays_overlap(said, words(L.ENGLISH)) | (F.size(F.array_intersect(said, words(L.FOREIGN))) < 2))


def wordlike(token: Column) -> Column:
    low = F.lower(token)
    return ~low.rlike("^[a-z]+$") | (F.length(low) <= 2) | (low.rlike("[aeiouy]") & ~low.rlike("[bcdfghjklmnpqrstvwxz]{5,}"))


def has_verb(text: Column) -> Column:
    said = tokens(text)
    return (
        has(text, L.COPULA)
        | F.arrays_overlap(F.transform(said, F.lower), words(L.IRREGULAR_VERBS))
        | F.exists(said, lambda t: (F.length(t) > 3) & F.lower(t).rlike("^[a-z0-9_]+(?:s|ed|ing)$"))
    )


def is_opinion(text: Column) -> Column:
    return has(text, L.OPINION) | has(text, L.BEST + f"(?!{L.BEST_MEASURED})")


def triage(statement: Column) -> Column:
    """A struct of kind, claim_type, search_worthwhile, salience and negated; the first rule that fits decides."""
    text = F.trim(F.coalesce(statement, F.lit("")))
    said = tokens(text)
    plain = F.filter(said, lambda t: t.rlike("^[A-Za-z]+$"))
    negated = has(text, L.NEGATION)
    salience = F.when(has(text, L.HIGH_IMPACT) & (has(text, L.SCOPE) | (F.size(said) <= 20)), "high").otherwise("normal")

    def outcome(kind: str, claim_type: str, search: bool = False) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(claim_type).alias("claim_type"), F.lit(search).alias("search_worthwhile"),
            (salience if search else F.lit("normal")).alias("salience"), (negated if search else F.lit(False)).alias("negated"),
        )

    return (
        F.when(text.rlike(r"^\s*https?://\S+\s*$"), outcome("not_a_claim", "link, not a claim"))
        .when(text.endswith("?"), outcome("not_a_claim", "question"))
        .when(~looks_english(text), outcome("not_a_claim", "unsupported language"))
        .when(F.size(said) < 4, outcome("not_a_claim", "incomplete claim"))
        .when((F.size(plain) > 0) & (F.size(F.filter(plain, wordlike)) < 0.6 * F.size(plain)), outcome("not_a_claim", "unrecognized text"))
        .when(~has_verb(text), outcome("not_a_claim", "not an assertion"))
        .when(is_opinion(text), outcome("opinion", "subjective"))
        .when(has(text, L.FUTURE) & ~has(text, L.ANNOUNCEMENT), outcome("prospective", "claim about a future event", True))
        .otherwise(outcome("checkable", "factual claim", True))
    )


# ---- decomposition ---------------------------------------------------------


def entities(text: Column) -> Column:
    phrases = F.transform(find_all(text, r"\b([A-Z][a-z]*(?:\s+[A-Z][a-z]*)*)\b", 1, KEEP), lambda e: F.trim(F.regexp_replace(e, r"^(?:The|A|An)\s+", "")))
    verb = lambda e: ~e.contains(" ") & F.lower(e).rlike("(?:ing|ed)$") & (F.length(e) > 4)
    kept = F.filter(phrases, lambda e: (e != "") & ~e.isin(*L.NON_ENTITIES) & ~verb(e))
    known = F.array_compact(F.array(*(F.when(has(text, rf"\b(?:{p.replace(' ', chr(92) + 's+')})\b"), F.lit(name)) for p, name in L.KNOWN_ENTITIES)))
    return let(kept, lambda k: F.array_distinct(F.concat(k, F.filter(F.array_distinct(known), lambda e: ~F.array_contains(F.transform(k, F.lower), F.lower(e))))))


def temporal(text: Column) -> Column:
    return F.flatten(F.array(*(F.transform(find_all(text, p, 1), lambda m: m) for p in L.TEMPORAL)))


def tense(text: Column) -> Column:
    return F.when(has(text, L.TENSE_FUTURE), "future").when(has(text, L.TENSE_PAST), "past").otherwise("present")


def numbers(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*(find_all(text, p) for p in L.NUMBERS))))


def claim_type(text: Column) -> Column:
    out = F.lit("factual")
    for name, pattern in reversed(L.CLAIM_TYPES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def modality(text: Column) -> Column:
    out = F.lit("factual")
    for name, pattern in reversed(L.MODALITIES):
        out = F.when(has(text, pattern), name).otherwise(out)
    return out


def predicates(text: Column) -> Column:
    copula = r"\b(is|was|are|were)\s+(?:being\s+)?(\w+(?:\s+\w+)?)\b"
    pairs = F.flatten(F.transform(F.arrays_zip(find_all(text, copula, 1).alias("a"), find_all(text, copula, 2).alias("b")), lambda m: F.array(m["a"], m["b"])))
    found = F.concat(pairs, find_all(text, r"\b(\w+ing)\b(?:\s+\w+)?\b", 1), find_all(text, r"\b(?:will|can|may|should)\s+(\w+)\b", 1), find_all(text, L.ACTION_VERBS))
    return F.array_distinct(F.filter(found, lambda p: ~F.lower(p).isin(*L.STOP_PREDICATES)))


def significant_words(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(find_all(F.lower(text), r"\b([a-z]+)\b", 1, KEEP), lambda n: (F.length(n) > 2) & ~n.isin(*L.NOUN_STOPWORDS))))


def rename_targets(text: Column, entity_list: Column) -> Column:
    """What the entities are renamed to; the patterns come from the row."""
    target = lambda e: F.regexp_extract_all(text, F.concat(F.lit(r"(?iU)\Q"), e, F.lit(r"\E\s+(?:to|into|as)\s+(\w+(?:\s+\w+)?)")), F.lit(1))
    renamed = F.lower(text).contains("renamed") | F.lower(text).contains("changed name")
    return F.when(renamed, F.array_distinct(F.flatten(F.transform(entity_list, target)))).otherwise(F.array().cast("array<string>"))


def sentiment(text: Column, kind: Column) -> Column:
    return F.when(kind.isin("numerical", "comparative"), F.when(has(text, L.RISING), "positive").when(has(text, L.FALLING), "negative"))


def attribution(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, "(?iU)" + L.ATTRIBUTION, 0)), F.lit(""))


def decompose(text: Column) -> Column:
    """All parts of a claim as one struct."""
    return let(entities(text), lambda e: F.struct(
        claim_type(text).alias("claim_type"), e.alias("entities"), significant_words(text).alias("words"), predicates(text).alias("predicates"), numbers(text).alias("numbers"),
        temporal(text).alias("temporal"), tense(text).alias("tense"), sentiment(text, claim_type(text)).alias("sentiment"), find_all(text, L.CONFIDENCE, 1).alias("confidence"),
        modality(text).alias("modality"), rename_targets(text, e).alias("rename_targets"), has(text, L.DECOMPOSED_NEGATION).alias("negation"), attribution(text).alias("attribution"),
    ))


# ---- events ----------------------------------------------------------------


def events(text: Column) -> Column:
    """Events whose surface forms occur, by 18 compiled alternations."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(any_of(forms)), F.lit(event)) for event, forms in L.EVENT_SURFACES.items())))


def opposites(event_list: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for a, b in L.OPPOSITES for x in (a, b, b, a)))
    return F.filter(F.transform(event_list, lambda e: pairs[e]), lambda e: e.isNotNull())


def surface_forms(text: Column) -> Column:
    """Surface forms by their first place, without a form that is part of an earlier one."""
    forms = list(dict.fromkeys(f for fs in L.EVENT_SURFACES.values() for f in fs))
    place = lambda low, f: F.regexp_instr(low, F.concat(F.lit(r"(?<![a-z])\Q"), f, F.lit(r"\E(?![a-z])")))
    # Few forms occur at all: only those are looked for with their bounds.
    there = lambda low: F.filter(words(forms), lambda f: low.contains(f))
    found = let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array_sort(F.filter(F.transform(there(low), lambda f: F.struct(place(low, f).alias("at"), f.alias("form"))), lambda s: s["at"] > 0)))
    return F.aggregate(F.transform(found, lambda s: s["form"]), F.array().cast("array<string>"), lambda kept, f: F.when(F.exists(kept, lambda k: k.contains(f) & (k != f)), kept).otherwise(F.concat(kept, F.array(f))))


# ---- time ------------------------------------------------------------------


def recent_marker(text: Column) -> Column:
    """The first listed marker of recent time that occurs, or null."""
    # Few markers occur at all: only those are looked for with their bounds.
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.coalesce(*(F.when(low.contains(m) & low.rlike(whole(m)), F.lit(m)) for m in L.RECENT_MARKERS)))


def time_anchor(text: Column, marker: Column | None = None) -> Column:
    dated = has(text, r"\b(19|20)\d{2}\b") | has(text, rf"\b({L.MONTHS})\b")
    marker = recent_marker(text) if marker is None else marker
    return F.when(marker.isNotNull(), "recent").when(dated, "dated").otherwise("none")


def resolve_mode(claim: Column, requested: Column, submitted: Column) -> Column:
    """A struct of anchor, marker, requested, from_label, mode, window_days and reason: request, then text, then label."""
    asked = F.lower(F.trim(F.coalesce(requested, F.lit("auto"))))
    asked = F.when(asked.isin("recent", "historical"), asked).otherwise("auto")

    def anchored(x: Column) -> Column:
        by_label = (x["asked"] == "auto") & x["marker"].isNull() & x["label"].isin(*L.RECENCY_LABELS)
        anchor = F.when(x["asked"] == "recent", "recent").when(x["asked"] == "historical", "none").when(by_label, "recent").otherwise(time_anchor(claim, x["marker"]))
        said = F.when(x["asked"] != "auto", "").when(by_label, x["label"]).otherwise(F.coalesce(x["marker"], F.lit("")))
        return F.struct(x["asked"].alias("asked"), by_label.alias("by_label"), anchor.alias("anchor"), said.alias("said"))

    def resolved(x: Column) -> Column:
        mode = F.when(x["anchor"] == "recent", "recent").otherwise("historical")
        reason = (
            F.when(x["asked"] != "auto", F.format_string(L.ANCHOR_REASONS["asked"], mode))
            .when(x["by_label"], F.format_string(L.ANCHOR_REASONS["label"], F.upper(x["said"])))
            .when(x["said"] != "", F.format_string(L.ANCHOR_REASONS["marker"], x["said"]))
            .when(x["anchor"] == "dated", L.ANCHOR_REASONS["dated"])
            .otherwise(L.ANCHOR_REASONS["none"])
        )
        return F.struct(
            x["anchor"].alias("anchor"), x["said"].alias("marker"), x["asked"].alias("requested"), x["by_label"].alias("from_label"), mode.alias("mode"),
            F.when(x["anchor"] == "recent", L.RECENT_WINDOW_DAYS).alias("window_days"), reason.alias("reason"),
        )

    # Marker and label are searched for once, not where each of these is used.
    return let(let(F.struct(asked.alias("asked"), recent_marker(claim).alias("marker"), leading_label(submitted).alias("label")), anchored), resolved)


# ---- known facts -----------------------------------------------------------


def arithmetic(expression: Column) -> Column:
    """The value of an expression of numbers, brackets and + - * / ** , or null; Arrow batches, no evaluation of code."""
    @F.pandas_udf("double")
    def value(texts: pd.Series) -> pd.Series:
        return texts.map(calculate).astype("float64")

    return value(expression)


def calculate(text: str | None) -> float | None:
    """A calculator by precedence climbing: unary signs, **, * and /, + and -; None for anything else or from 1e12 on."""
    import re

    parts = re.findall(r"\s*(\d+\.?\d*|\.\d+|\*\*|[-+*/()]|\S)", text or "")
    at = 0

    def peek():
        return parts[at] if at < len(parts) else None

    def take():
        nonlocal at
        at += 1
        return parts[at - 1]

    def atom():
        if peek() == "(":
            take()
            out = level(0)
            if peek() != ")":
                raise ValueError
            take()
            return out
        return float(take())

    def power():
        base = atom()
        if peek() == "**":
            take()
            base = base ** signed()
        return base

    def signed():
        if peek() in ("+", "-"):
            return -signed() if take() == "-" else signed()
        return power()

    def level(rank):
        out = signed() if rank else level(1)
        while peek() in (("+", "-"), ("*", "/"))[rank]:
            sign = take()
            right = signed() if rank else level(1)
            out = out + right if sign == "+" else out - right if sign == "-" else out * right if sign == "*" else out / right
        return out

    try:
        out = level(0)
        return out if at == len(parts) and isinstance(out, float) and abs(out) < 1e12 else None
    except (ValueError, IndexError, ZeroDivisionError, OverflowError, TypeError, RecursionError):
        return None


def known_fact(statement: Column, with_arithmetic: bool = True) -> Column:
    """A struct of verdict, claim_type and confidence for claims that rules decide, else null."""
    text = F.regexp_replace(F.lower(collapse(statement)), r"[.!?]+$", "")
    result = lambda verdict, kind, sure="very high": F.struct(verdict.alias("verdict"), F.lit(kind).alias("claim_type"), F.lit(sure).alias("confidence"))
    out = F.when(has(text, L.SUBJECTIVE) | has(text, L.BEST + f"(?!{L.BEST_MEASURED})"), result(F.lit("not objectively verifiable"), "subjective", "high"))
    if with_arithmetic:
        equation = r"^(?:what is )?(-?[\d\s()+*/.%.-]+)\s*=\s*(-?[\d.]+)$"
        left, right = F.regexp_extract(text, equation, 1), F.regexp_extract(text, equation, 2)
        actual = arithmetic(F.replace(left, F.lit("%"), F.lit("/100")))
        same = F.when(F.abs(actual - right.try_cast("double")) < 1e-9, "true").otherwise("false")
        out = F.when(text.rlike(equation) & actual.isNotNull(), result(same, "mathematical")).otherwise(out)
    for verdict, rules in (("false", L.FALSE_FACTS), ("true", L.TRUE_FACTS)):
        for pattern, kind in reversed(rules):
            out = F.when(has(text, pattern), result(F.lit(verdict), kind)).otherwise(out)
    return F.when(~has(text, L.QUALIFIED), out)


def usable_headline(title: Column) -> Column:
    """Whether a headline asserts something that can be checked: no question, opinion, list or live page."""
    return (word_total(title) >= 5) & ~F.rtrim(title).endswith("?") & ~has(title, L.HEADLINE_KINDS) & ~has(title, L.HEADLINE_SHAPES) & (triage(title)["kind"] == "checkable")
