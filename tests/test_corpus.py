"""Titles and retrieval over whole tables, against plain folds and full scores."""

import math
import random
import re

import pytest

from factloom.functions import lexicon as L
from factloom.functions import quantities as Q
from factloom.operators import retrieval, titles
from factloom.operators import search as S

TURNED = [({s for s in L.EVENT_SURFACES[a] if " " not in s}, {s for s in L.EVENT_SURFACES[b] if " " not in s}) for x, y in L.OPPOSITES for a, b in ((x, y), (y, x))]


def title_key(title):
    key = re.sub(r"[^a-z0-9\s]", "", (title or "").strip().lower())
    return re.sub(r"\s+", " ", re.sub(rf"\b({L.TITLE_PUBLISHERS})\b", "", key)).strip()


def opposite(a, b):
    return bool((a ^ b) & set(L.POLARITY)) or any(a & x and b & y for x, y in TURNED)


def fold(rows):
    """What stays, group by group, in order of arrival."""
    out = []
    for group in {r[0] for r in rows}:
        urls, keys, kept = set(), set(), []
        for r in sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2], r[3] or "", r[4] or "")):
            key = title_key(r[4])
            tokens = set(key.split())
            if not r[3] or r[3] in urls:
                continue
            urls.add(r[3])
            if key and key in keys:
                continue
            keys.add(key)
            if len(tokens) >= 6:
                if any(100 * len(tokens & k) >= 85 * len(tokens | k) and not opposite(tokens, k) for k in kept):
                    continue
                kept.append(tokens)
            out.append(r)
    return sorted(map(str, out))


def results(seed, n, groups, base_titles):
    r = random.Random(seed)
    words = [a + b for a in "bdfgkm" for b in ("ank", "ill", "ore", "ush")]
    bases = [r.sample(words, r.randint(5, 16)) for _ in range(base_titles)]
    rows = []
    for i in range(n):
        title = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            title[r.randrange(len(title))] = r.choice([*words, f"x{r.randrange(50)}", "not", "approves", "rejects", "Reuters"])
        group = 0 if r.random() < 0.4 else r.randrange(groups)
        rows.append((group, r.randrange(4), i, r.choice([None, "", *[f"u{r.randrange(2 * n)}"] * 12]), r.choice([" ".join(title), " ".join(title).upper() + "!", None if i % 40 == 0 else " ".join(title)])))
    return rows


SCHEMA = "claim_id long, job_order int, ord int, url string, title string"


@pytest.mark.parametrize("rounds", [0, 16])
def test_distinct_titles_against_the_fold(spark, monkeypatch, rounds):
    """A hot group, chains in which a near-copy of a dropped title stays, opposite titles; by pairs alone and with rounds."""
    monkeypatch.setattr(titles, "ROUNDS", rounds)
    rows = results(3, 400, 6, 12)
    chain = "a b c d e f g h i j k l m n o p q r s t".split()
    rows += [(9, i, 0, f"c{i}", " ".join(f"z{j}" if j < i else w for j, w in enumerate(chain))) for i in range(12)]
    want = fold(rows)
    got = titles.distinct_titles(spark.createDataFrame(rows, SCHEMA).repartition(5), "claim_id")
    assert got.columns == ["claim_id", "job_order", "ord", "url", "title"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want and len(want) < 350


def test_distinct_titles_equal_the_fold_in_the_row(spark):
    rows = [r for r in results(4, 300, 20, 15) if r[3]]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(str, titles.distinct_titles(frame, "claim_id").collect())) == sorted(map(str, S.deduplicate(frame).select(*frame.columns).collect()))


def test_distinct_titles_over_all_and_odd_rows(spark):
    rows = [(i, 0, i, f"u{i}", t) for i, t in enumerate(["one two three four five six seven", "seven one two three four five six", "short title", "short title", None, None, "", "ONE two three four five six seven"])]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'k' as key", "1 as place", "2 as tokens")
    got = titles.distinct_titles(frame)
    assert got.columns == frame.columns and sorted(r.ord for r in got.collect()) == [0, 2, 4, 5, 6]
    assert titles.distinct_titles(frame.limit(0)).count() == 0


def top(claims, docs, most):
    held = {d: set(w or ()) for d, w in docs if d is not None}
    df = {}
    for w in held.values():
        for x in w:
            df[x] = df.get(x, 0) + 1
    out = []
    for c, words in claims:
        scores = []
        for d, w in held.items():
            both = set(words or ()) & w
            if c is not None and both:
                scores.append((-sum(round(math.log1p(len(held) / df[x]) * retrieval.SCALE) for x in both), d))
        out += [(c, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scores)[:most])]
    return sorted(out)


@pytest.mark.parametrize("tried, hot", [(50, 1000), (1, 20), (0, 3)])
def test_corpus_top_against_all_scores(spark, monkeypatch, tried, hot):
    """Words in every document, bounds that leave words out, and none; ties go by id."""
    monkeypatch.setattr(retrieval, "TRIED", tried)
    monkeypatch.setattr(retrieval, "HOT", hot)
    r = random.Random(tried)
    docs = [(i, ["all", *(f"w{int(r.expovariate(0.05))}" for _ in range(r.randrange(25)))]) for i in range(300)] + [(900, None), (901, []), (None, ["all", "w1"])]
    claims = [(i, ["all", *(f"w{int(r.expovariate(0.05))}" for _ in range(r.randrange(1, 9)))]) for i in range(30)] + [(50, ["nowhere"]), (51, []), (52, None), (53, ["all"]), (54, ["w3", "w3", "all"]), (None, ["all"])]
    got = retrieval.corpus_top(spark.createDataFrame(claims, "claim_id long, words array<string>"), spark.createDataFrame(docs, "doc_id long, words array<string>"), 5)
    assert sorted(tuple(x) for x in got.collect()) == top(claims, docs, 5)


def test_corpus_top_skips_common_words(spark, monkeypatch):
    """With a bound from rare words a word of all documents leads to no candidates."""
    asked = []
    looked_up = retrieval.looked_up
    monkeypatch.setattr(retrieval, "looked_up", lambda terms, postings: asked.append(terms) or looked_up(terms, postings))
    docs = [(i, ["all", f"w{i % 20}"]) for i in range(400)]
    claims = [(i, ["all", f"w{i}"]) for i in range(5)]
    found = retrieval.corpus_top(spark.createDataFrame(claims, "claim_id long, words array<string>"), spark.createDataFrame(docs, "doc_id long, words array<string>"), 3)
    assert sorted(tuple(x) for x in found.collect()) == top(claims, docs, 3)
    assert {x.word for x in asked[1].collect()} == {f"w{i}" for i in range(5)}




def test_agreeing_documents_against_all_pairs(spark):
    """Values at the ends of bands, zero, signs, kinds and words, against a comparison of all pairs."""
    r = random.Random(7)
    number = lambda: r.choice(["0", "1", "98", "100", "102", "102.05", "5,000", "4,900", "4,899", "2 million", "1,960,000", f"{r.uniform(1, 9):.3f}", str(r.randrange(1, 200))])
    say = lambda: " and ".join(f"{r.choice(['rates', 'prices', 'exports', 'growth'])} reached {r.choice(['', '$'])}{number()}{r.choice([' percent', '', ' tonnes'])} {r.choice(['output', 'margin'])}" for _ in range(r.randint(1, 3)))
    claims, docs = [(i, say()) for i in range(40)] + [(90, None), (None, say())], [(i, say()) for i in range(80)] + [(90, ""), (None, say())]
    got = Q.agreeing_documents(spark.createDataFrame(claims, "claim_id long, claim string"), spark.createDataFrame(docs, "doc_id long, text string"))
    want = {}
    for c, text in claims:
        for value, kind, words, said in Q.find_quantities(text) if c is not None else []:
            for d, other in docs:
                for v, k, w, s in Q.find_quantities(other) if d is not None else []:
                    if kind == k and set(words) & set(w) and abs(value - v) <= Q.TOLERANCE * max(abs(value), abs(v)):
                        want[c, said, d] = min(s, want.get((c, said, d), s))
    assert sorted(tuple(x) for x in got.collect()) == sorted((*k, v) for k, v in want.items()) and len(want) > 60
