"""A benchmark from headlines: each as reported and, where it can be, corrupted; outcomes and tallies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexicon as L
from factloom.functions.claims import surface_forms, usable_headline
from factloom.functions.quantities import find_quantities

TIMES = 7


def ending(form: str) -> str:
    """How a surface form ends, as far as its opposite must end alike."""
    found = re.search(r"(ing|ed|(?<!s)s)$", form)
    return found.group() if found else ""


def opposite_forms() -> dict[str, str]:
    """For each surface form of an event with an opposite, the opposite's form of the same ending, nearest to the event's name."""
    table = {}
    for pair in L.OPPOSITES:
        for event, other in (pair, pair[::-1]):
            near = sorted(L.EVENT_SURFACES[other], key=lambda f: not f.startswith(other))
            by_end = {e: next((f for f in near if " " not in f and f.endswith(e)), near[0]) for e in ("ing", "ed", "s")} | {"": near[0]}
            table |= {f: by_end[ending(f)] for f in L.EVENT_SURFACES[event]}
    return table


def base_forms() -> dict[str, str]:
    """The base of each regular form, if the event has it as a form too."""
    table = {}
    for forms in L.EVENT_SURFACES.values():
        for base in forms:
            regular = {base + "s", base + "es", base + "ed", base + "d", base[:-1] + "ies", base[:-1] + "ied"}
            table |= {f: base for f in forms if f in regular and re.search(r"(?<!s)s$|ed$", f) and " " not in f}
    return table


def build_cases(headlines: DataFrame, text: str = "headline") -> DataFrame:
    """origin, claim, truth, strategy: one or two rows for each usable headline, distinct by text.

    The second is corrupted: its event turned round, its first number times
    seven, or a negation, tried in an order that a hash of the headline gives.
    """
    turned, bases = opposite_forms(), base_forms()

    def replace(text: str, old: str, new: str) -> str | None:
        out = re.sub(rf"(?<![a-z]){re.escape(old)}(?![a-z])", lambda _: new, text, count=1, flags=re.IGNORECASE)
        return out if out.lower() != text.lower() else None

    def antonym(text, forms, _):
        return replace(text, forms[0], turned[forms[0]]) if forms and forms[0] in turned else None

    def number(text, _, found):
        digits = re.search(r"\d[\d,.]*", found[0]) if found else None
        value = float(digits.group().rstrip(".,").replace(",", "")) if digits else 0.0
        if not value:
            return None
        changed = found[0].replace(digits.group(), f"{value * TIMES:,.0f}" if value >= 1 else "0.5")
        out = text.replace(found[0], changed, 1)
        return out if out != text else None

    def negate(text, forms, _):
        at = re.search(r"\b(?:was|were|is|are|has|have|will)\b", text, re.IGNORECASE)
        if at:
            return f"{text[: at.end()]} not{text[at.end() :]}"
        return replace(text, forms[0], f"did not {bases[forms[0]]}") if forms and forms[0] in bases else None

    ways = (("antonym", antonym), ("number", number), ("negate", negate))

    def run(batches):
        for batch in batches:
            out = []
            for text, f, o in zip(batch["origin"], batch["forms"], batch["way"], strict=True):
                f, q = list(f), [x[3] for x in find_quantities(text)]
                ranked = [ways[(o + i) % 3] for i in range(3)]
                made = ((way(text, f, q), name) for name, way in (ranked if o % 2 else [ranked[0], ranked[2], ranked[1]]))
                out.append((text, text, "reported", None))
                out += [(text, c, "corrupted", name) for c, name in made if c][:1]
            yield pd.DataFrame(out, columns=["origin", "claim", "truth", "strategy"])

    rows = headlines.select(F.col(text).alias("origin")).filter(usable_headline(F.col("origin"))).distinct()
    rows = rows.select("origin", surface_forms(F.col("origin")).alias("forms"), F.pmod(F.xxhash64(F.lit(7), "origin"), F.lit(6)).cast("int").alias("way"))
    return rows.mapInPandas(run, "origin string, claim string, truth string, strategy string")


#: Searches that give headlines, and how old these may be.
TOPICS, HEADLINE_DAYS = ("world news", "politics", "economy", "technology", "health"), 1


def sample_headlines(articles: DataFrame, limit: int, topic: str | None = None) -> DataFrame:
    """The first ``limit`` usable headlines of (ord, topic, title), one for each title key, of all topics or one."""
    from factloom.operators.search import title_key

    rows = articles.filter(usable_headline(F.col("title")))
    if topic is not None:
        rows = rows.filter(F.col("topic") == topic)
    first = rows.withColumn("key", title_key(F.col("title"))).groupBy("key").agg(F.min_by(F.struct(*articles.columns), "ord").alias("one")).select("one.*")
    return first.orderBy("ord").limit(limit)


def outcome(truth: Column, status: Column) -> Column:
    against = status.isin("contradicted", "unsupported_no_coverage")
    for_it = status == "supported"
    right, wrong = F.when(truth == "reported", for_it).otherwise(against), F.when(truth == "reported", against).otherwise(for_it)
    return F.when(right, "correct").when(wrong, "wrong").otherwise("missed")


def tally(cases: DataFrame) -> DataFrame:
    """n, correct, missed, wrong and the rate of wrong answers by truth."""
    rows = cases.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "missed", "wrong")))
    return rows.withColumn("wrong_rate", F.col("wrong") / F.col("n"))


def run_cases(cases: DataFrame, check) -> DataFrame:
    """``cases`` (claim, truth) with the status that ``check`` (claim_id, statement to claim_id, status) gives them, and the outcome."""
    numbered = cases.withColumn("claim_id", F.xxhash64("claim", "truth"))
    judged = check(numbered.select("claim_id", F.col("claim").alias("statement"))).select("claim_id", "status")
    return numbered.join(judged, "claim_id", "left").withColumn("outcome", outcome(F.col("truth"), F.coalesce("status", F.lit("")))).drop("claim_id")
