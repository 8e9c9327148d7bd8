"""Row pattern matching against a backtracking matcher, on runs in one block and over many."""

import datetime
import math
import random

import pytest

from factloom.llm import row_patterns

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
START = datetime.datetime(2024, 1, 1)


def brute(rows, greedy=True, gap=900):
    """Every search by trying letters one after the other."""
    by_client: dict = {}
    for r in set(rows):
        if r[3] is not None and r[1] is not None:
            by_client.setdefault(r[3], []).append(r)
    out = []
    for client, own in by_client.items():
        own.sort(key=lambda r: (r[1], r[0]))
        cents = [math.floor(100 * r[5] + 0.5) if r[5] is not None and math.isfinite(r[5]) else None for r in own]

        def near(r):
            return (own[r][1] - own[r - 1][1]).total_seconds() <= gap

        def letter(r):
            if cents[r] is None or own[r][4] in (None, "error") or not near(r) or cents[r] == cents[r - 1]:
                return None
            return "D" if cents[r] < cents[r - 1] else "U"

        start, number = 0, 0
        while start < len(own):
            best = None
            if cents[start] is not None:
                reach, options = start, [start]
                while reach + 1 < len(own) and letter(reach + 1):
                    reach += 1
                    options.append(reach)
                for r in reversed(options) if greedy else options:
                    j = r + 1
                    if j < len(own) and cents[j] is not None and own[j][4] == "view" and cents[j] >= cents[start] and near(j):
                        best = j
                        break
            if best is None:
                start += 1
                continue
            k = best
            while k + 1 < len(own) and letter(k + 1) == "D":
                k += 1
            number += 1
            labels = "A" + "".join(letter(r) for r in range(start + 1, best)) + "P" + "D" * (k - best)
            out.append((client, number, own[start][0], own[k][0], k - start + 1, sum(cents[start : k + 1]), labels))
            start = k
    return sorted(out)


def clicks(seed, n, clients, broken=0.1, values=30):
    r = random.Random(seed)
    rows, at = [], dict.fromkeys(range(clients), START)
    for i in range(n):
        c = min(int(r.expovariate(0.7)), clients - 1)
        at[c] += datetime.timedelta(seconds=r.choice([0, 1, 60, 899, 900]) if r.random() > broken / 3 else 901)
        kind = r.choice(["view", "view", "click", "purchase"]) if r.random() > broken else r.choice(["error", None])
        value = r.randint(-3, values) / 10 if r.random() > broken / 3 else r.choice([None, float("nan")])
        rows.append((i, at[c], START, c if r.random() > 0.01 else None, kind, value, "{}"))
    return rows + rows[::9]


def got(spark, rows, parts=8, **options):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = row_patterns.row_patterns(spark.createDataFrame(rows, CLICKS), **options)
        return sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("greedy", [True, False])
@pytest.mark.parametrize("broken", [0.1, 0.0])
def test_against_backtracking(spark, greedy, broken):
    rows = clicks(1, 900, 5, broken)
    want = brute(rows, greedy)
    assert len(want) > 20 and got(spark, rows, greedy=greedy) == want


@pytest.mark.parametrize("greedy, whole", [(True, 4), (False, 40)])
def test_long_runs_and_small_blocks(spark, monkeypatch, greedy, whole):
    """Runs far longer than what a task takes, and blocks of a few rows: matched by joins."""
    monkeypatch.setattr(row_patterns, "WHOLE", whole)
    rows = clicks(2, 150, 2, 0.0, 300) + [(1000 + i, START + datetime.timedelta(seconds=i), START, 77, "view", float(500 - i), "") for i in range(30)]
    assert got(spark, rows, parts=5, greedy=greedy) == brute(rows, greedy)


def test_a_match_ends_where_the_next_begins(spark):
    rows = [(i, START + datetime.timedelta(minutes=i), START, 1, "view", float(v), "") for i, v in enumerate([5, 4, 7, 6, 3, 8, 8, 1])]
    assert got(spark, rows) == brute(rows) == [(1, 1, 0, 7, 8, 4200, "ADUDDUPD")]


def test_gap_options_and_odd_rows(spark):
    rows = clicks(5, 200, 3)
    assert got(spark, rows, gap_minutes=1) == brute(rows, gap=60)
    assert got(spark, []) == []
    assert got(spark, [(1, START, START, 1, "view", 1.0, ""), (2, None, START, 1, "view", 2.0, ""), (None, START, START, 2, None, None, "")]) == []
    table = spark.createDataFrame(rows, CLICKS).selectExpr("*", "'x' as cents", "1 as flags", "'p' as part")
    assert sorted(tuple(r) for r in row_patterns.row_patterns(table).collect()) == brute(rows)


def test_many_rows_at_one_time(spark):
    rows = [(i, START, START, 1, "view", float(i * 7 % 11), "") for i in range(100)]
    assert got(spark, rows, parts=16) == brute(rows)
