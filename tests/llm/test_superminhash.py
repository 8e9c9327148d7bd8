"""SuperMinHash signatures and the near-duplicate operator against brute force."""

import random

import numpy as np
import pytest

from factloom.llm import ngram_join, superminhash

from .test_operators import docs, empty, prose, shingles  # noqa: F401


def components(rows, n=4, percent=80):
    """Sizes and components by comparing all pairs; texts of one id are one document."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else -1, i is not None and find(i) == i) for i, s in sets)


def plain(rows):
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


def slow_signature(shingle_set, places):
    """By the definition: a permutation for each shingle, all of its steps, one after the other."""
    best = [superminhash.NOTHING] * places
    for s in shingle_set:
        order = list(range(places))
        for step in range(places):
            index, rank = (int(x[0]) for x in superminhash.draws(np.array([s]), step, places))
            order[step], order[index] = order[index], order[step]
            best[order[step]] = min(best[order[step]], rank)
    return best


@pytest.mark.parametrize("together", [7, 1 << 17])
def test_signatures_by_the_definition(monkeypatch, together):
    monkeypatch.setattr(superminhash, "TOGETHER", together)
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 9, 40, 3, 700)]
    got = superminhash.signatures(sets, 24)
    assert got.tolist() == [slow_signature(s, 24) for s in sets]


def test_signatures_estimate_with_less_variance():
    r = np.random.default_rng(4)
    errors = []
    for _ in range(60):
        all_of = r.integers(0, 2**63, 120).astype(np.uint64)
        a, b = superminhash.signatures([np.unique(all_of[:110]), np.unique(all_of[10:])])
        errors.append(float(np.mean(a == b)) - 100 / 120)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < np.sqrt(100 / 120 * 20 / 120 / superminhash.BANDS / superminhash.ROWS)


def test_against_all_pairs(spark, docs):  # noqa: F811
    got = superminhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert plain(got.collect()) == components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_pairs_around_the_limit(spark):
    """Single words changed here and there put pairs just above and just below the limit."""
    r = random.Random(8)
    rows = []
    for g in range(40):
        text = prose(30 + 5 * g, 400 + g).split()
        for _ in range(3):
            new = list(text)
            for _ in range(r.randint(1, max(1, len(text) // 36))):
                new[r.randrange(len(new))] = f"w{r.random()}"
            rows.append((len(rows), " ".join(new)))
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = components(rows)
    assert plain(got.collect()) == want and 50 < len({c for _, _, c, _ in want}) < 115


def test_groups_and_chains_in_blocks(spark, monkeypatch):
    """A chain that only links step by step, and a group of copies with others around one passage, in small blocks."""
    monkeypatch.setattr(ngram_join, "GATHERED", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    long = prose(400, 3).split()
    rows = [" ".join(long[8 * i : 8 * i + 100]) for i in range(20)]
    base = prose(90, 44)
    rows += [f"{base} {prose(1 + i % 25, 900 + i)}" for i in range(40)]
    rows = list(enumerate(rows))
    assert plain(superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()) == components(rows)


def test_odd_tables(spark):
    assert superminhash.near_duplicates(empty(spark)).count() == 0
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "a b c d e f"), (6, prose(50, 1)), (2**40, prose(50, 1) + " x"), (7, "é é é é é")]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as tiles", "2 as class"))
    found = plain(got.collect())
    assert (2**40, 48, 6, False) in found and (5, 1, 4, False) in found and (-1, 3, -1, False) in found and (7, 1, 7, True) in found
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)} <= set(found)
