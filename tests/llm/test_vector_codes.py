"""Product codes against plain Lloyd's rounds."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v], c) for i, v, c in rows if v and None not in v and np.isfinite(v).all() and len(v) % parts == 0 and max(map(abs, v)) < 65536]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or 0))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    by_label: dict = {}
    for (_, _, c), e in zip(kept, error, strict=True):
        by_label[c] = by_label.get(c, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i if i is not None else -1), "".join(f"{k:02x}" for _, k in f), e, by_label[c], digest) for (i, _, c), f, e in zip(kept, found, error, strict=True))


def table(n, dims, seed, spread=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (7, dims))
    return [(i * 3, (centres[i % 7] + r.normal(0, spread, dims)).astype(np.float32).tolist(), [None, 1, 2, 2, 2][i % 5]) for i in range(n)]


def plain(frame):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in frame.collect())


@pytest.mark.parametrize("chunk", [5, 64])
def test_against_plain_rounds(spark, chunk):
    rows = table(150, 16, 1) + [(1000, [0.25] * 16, 9), (1001, [0.25] * 16, 9), (1001, [0.25] * 16, 9)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    for rounds in (0, 1, 2, 6):
        want = brute(rows, 4, 9, rounds)
        found, books = vector_codes.compress(frame, 4, 9, rounds, chunk)
        assert sorted((r.vec_id, r.code, r.error) for r in found.collect()) == [w[:3] for w in want]
        assert books.digest() == want[0][4]
    assert plain(vector_codes.vector_codes(frame, 4, 9, 2)) == brute(rows, 4, 9, 2)


def test_bounds_spare_rescans(spark):
    """Far groups: after the first rounds hardly a part is looked at anew."""
    rows = table(400, 8, 2, 0.01)
    found, _ = vector_codes.compress(spark.createDataFrame(rows, VECTORS), 2, 7, 5)
    assert found.agg(F.sum("scanned")).first()[0] < 0.1 * 2 * 400
    assert sorted((r.vec_id, r.code, r.error) for r in found.collect()) == [w[:3] for w in brute(rows, 2, 7, 5)]


def test_stored_heaps_are_the_same():
    r = np.random.default_rng(3)
    vectors = r.integers(-50, 50, (40, 8)).astype(np.int32)
    chunk = vector_codes.Chunk(vectors, 2, 5)
    chunk.first(r.integers(-50, 50, (2, 5, 4)))
    again = vector_codes.Chunk.stored(chunk.store(), 2, 5)
    assert again.heaps == chunk.heaps and (again.vectors == vectors).all() and (again.codes() == chunk.codes()).all()


def test_odd_tables(spark):
    empty = vector_codes.vector_codes(spark.createDataFrame([], VECTORS))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    odd = [(1, None, 1), (2, [], 1), (3, [1.0, None] * 8, 1), (4, [float("nan")] * 16, 1), (5, [float("inf")] * 16, 1), (6, [1.0] * 15, 1), (7, [1e30] * 16, 1)]
    assert vector_codes.vector_codes(spark.createDataFrame(odd, VECTORS)).count() == 0
    rows = [*odd, (8, [0.5] * 16, None), (9, [-0.001] * 16, None), (None, [3.0] * 16, 4), (10, [0.1] * 32, 5)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as vector", "'x' as code", "2 as error")
    assert plain(vector_codes.vector_codes(frame)) == brute(rows, 16, 64, 2)
    again = [(0, [0.1] * 32, 5), *rows]
    assert plain(vector_codes.vector_codes(spark.createDataFrame(again, VECTORS))) == brute(again, 16, 64, 2)
