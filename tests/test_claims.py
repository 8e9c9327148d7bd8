"""Claim functions on stated cases."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import claims as C
from factloom.functions import quantities as Q
from factloom.operators import search as S


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalise(spark):
    given = {
        "BREAKING: Google bans Chrome!!!": "Google bans Chrome!", "Is it true that the moon is cheese?": "the moon is cheese", "“The tax rose” - The Daily News": "The tax rose",
        "Who won the vote?": "Who won the vote?", "tax cuts https://t.co/x #tax @you": "tax cuts", "🔥 Rates rose 🔥, can anyone confirm this?": "Rates rose", "#only": "#only", "ﬁne rose": "fine rose",
    }
    assert apply(spark, list(given), C.normalize_claim) == list(given.values())
    assert apply(spark, [None, ""], C.normalize_claim) == ["", ""]


def test_triage_order(spark):
    given = {
        "https://a.com/b": "link, not a claim", "Is the earth flat": "factual claim", "Is the earth flat?": "question", "too short now": "incomplete claim", "El perro de la casa que come": "unsupported language",
        "Президент подписал новый закон сегодня": "unsupported language", "sdfgh jklmn qwrtp zxcvb": "unrecognized text", "the quiet old red barn": "not an assertion", "Pizza is the best food ever": "subjective",
        "It is the best-selling album of 1982": "factual claim", "The senate will vote on the bill": "claim about a future event", "Officials said the senate will vote": "factual claim",
    }
    assert [x.claim_type for x in apply(spark, list(given), C.triage)] == list(given.values())
    assert apply(spark, ["The president did not resign today"], C.triage)[0].negated and apply(spark, ["Apple acquires Tesla in a large deal"], C.triage)[0].salience == "high"


def test_decomposition(spark):
    d = apply(spark, ["The United States was renamed to India by 2050 and fell 20% in 2019, officials said"], C.decompose)[0]
    assert d.entities == ["United States", "India"] and d.temporal[:2] == ["by 2050", "2019"] and d.tense == "future" and "2050" in d.numbers and d.attribution == "officials"
    assert "renamed" in d.predicates and not d.negation
    assert apply(spark, ["Burma renamed Burma as Myanmar Union yesterday"], lambda c: C.rename_targets(c, C.entities(c)))[0] == ["Myanmar Union"]


def test_events_and_forms(spark):
    assert apply(spark, ["He was forced to step down after the shutdown", "banner rose", None], C.events) == [["resign", "close"], ["increase"], []]
    assert apply(spark, ["prices shut down then shut"], C.surface_forms)[0] == ["shut", "shut down"]
    assert apply(spark, ["It raised rates and then banned cars"], C.surface_forms)[0] == ["raised", "banned"]


def test_splitting(spark):
    assert apply(spark, ["Mr. Smith went home early. The U.S. senate passed the bill.", "One two three four. Short one."], C.extract_claims) == [
        ["Mr. Smith went home early.", "The U.S. senate passed the bill."], ["One two three four. Short one."],
    ]
    assert apply(spark, ["Same words said here. same words said here."], C.extract_claims)[0] == ["Same words said here."]


def test_time(spark):
    rows = spark.createDataFrame([("He resigned today", None, "x"), ("It rose in 1999", "nonsense", "x"), ("It rose", "recent", "x"), ("It rose today", "historical", "x"), ("It rose", None, "JUST IN: It rose")], "c string, r string, s string")
    got = [tuple(x.x)[:5] for x in rows.select(C.resolve_mode(F.col("c"), F.col("r"), F.col("s")).alias("x")).collect()]
    assert [g[0] for g in got] == ["recent", "dated", "recent", "none", "recent"] and [g[4] for g in got] == ["recent", "historical", "recent", "historical", "recent"]


@pytest.mark.parametrize(("text", "value"), [("2+2*3", 8.0), ("-2**2", -4.0), ("(1+2)*3/4", 2.25), ("2**-1", 0.5), ("1/0", None), ("2 2", None), ("9**99", None), ("2**3**2", 512.0), ("", None), ("1--1", 2.0), ("(1", None)])
def test_calculator(text, value):
    assert C.calculate(text) == value


def test_known_facts(spark):
    given = ["Water freezes at 0°C at sea level.", "A triangle has four sides!", "It is a myth that a triangle has four sides", "2 + 2 = 5", "50% * 4 = 2", "Sushi is delicious", "Nothing here"]
    got = [x.verdict if x else None for x in apply(spark, given, C.known_fact)]
    assert got == ["true", "false", None, "false", "true", "not objectively verifiable", None]


def test_quantities_and_conflicts(spark):
    found = Q.find_quantities("Unemployment fell to 3.5 percent while $2 billion was spent on 1,200 schools")
    assert [(v, k) for v, k, *_ in found] == [(3.5, "percent"), (2e9, "currency"), (1200.0, "count")] and "unemployment" in found[0][2]
    rows = [("Unemployment fell to 3.5 percent", ["Unemployment rose to 7 percent in May"], True), ("Unemployment fell to 3.5 percent", ["Unemployment was 3.52 percent"], False), ("Unemployment fell", ["Unemployment 7 percent"], False)]
    got = Q.conflicting_documents(spark.createDataFrame(rows, "claim string, passages array<string>, expected boolean")).collect()
    assert [r.claimed is not None for r in got] == [r.expected for r in got]


def test_queries_are_ranked_and_distinct(spark):
    rows = spark.createDataFrame([(1, "Apple banned TikTok in the United States by 2025."), (2, "prices keep going higher everywhere")], "claim_id int, claim string")
    got = S.generate_queries(rows).orderBy("claim_id", "rank").collect()
    one = [r for r in got if r.claim_id == 1]
    assert one[0].purpose == "proposition" and one[1].query == "Apple banned" and len(one) <= 12
    assert len({r.query.lower() for r in one}) == len(one) and [r.rank for r in one] == list(range(1, len(one) + 1))
    assert [r.query for r in got if r.claim_id == 2][0] == "prices keep going higher everywhere"


def test_near_duplicates_keep_opposites(spark):
    title = "Court approves the new plan for city schools today"
    rows = [(1, 1, i, f"http://x/{i}", t) for i, t in enumerate([title, title.upper(), title + " again", title.replace("approves", "rejects"), "Other story", "", ""])] + [(1, 2, 0, "http://x/0", "dup url")]
    got = S.deduplicate(spark.createDataFrame(rows, "claim_id int, job_order int, ord int, url string, title string")).collect()
    assert sorted(r.url[-1] for r in got) == ["0", "3", "4", "5", "6"]


def test_patterns_from_the_full_stop_protect_the_same(spark):
    """What looks back from a full stop changes what the words before it did, and stock phrases are found as one pattern."""
    import re

    from factloom.functions import lexicon as L
    from factloom.functions.patterns import one_of, swap

    texts = ["Dr. No met Mr. X. vs. etc. U.S. E.U.S. u.k.U.N. D.C. and U.S.S. Madr. édr. co.corp.no. 5.St. x_dr. \u017ft. U.\u017f.", "", ".U.S.", "Mr.. Mrs. .dr.", "d.c.d.c. e.u.n. u.n.u.s."]
    old = F.col("t")
    old = swap(old, rf"\b({'|'.join(L.ABBREVIATIONS)})\.", "$1" + C._DOT)
    for first, second in (p.split(".") for p in L.DOTTED):
        old = swap(old, rf"\b({first})\.({second})\.", f"$1{C._DOT}$2{C._DOT}")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(C.protect(F.col("t")).alias("new"), old.alias("old")).collect()
    assert all(r.new == r.old for r in rows) and C._DOT in rows[0].new
    stock = one_of(L.BOILERPLATE)
    for text in (*L.BOILERPLATE, "x" + L.BOILERPLATE[3] + "y", "a week before", "copyright", "sign up for the", "no"):
        assert bool(re.search(stock, text)) == any(p in text for p in L.BOILERPLATE)
    assert stock.startswith("(?:") and stock.count("|") >= 15 and re.fullmatch(one_of(["ab", "a", "b."]), "b.") and not re.fullmatch(one_of(["ab", "b."]), "bx")
