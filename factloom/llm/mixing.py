"""Mixing sources to target weights by the cube method.

Every document is taken floor(m) times, m being its source's target over its
source's size; the cube method decides which documents are taken once more.
Their inclusion probabilities move within the null space of two constraints,
the source's number of documents and of words, until each is 0 or 1 but for a
few in each block; these meet in later rounds, and the last few are landed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, mix, word_count

#: Weights of the sources in the order of their names, repeating, and the mix's size of all words.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Rows of one flight.
BLOCK_ROWS = 1024


def flight(probability: np.ndarray, words: np.ndarray, group: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Probabilities after the flight phase: at most two of a group stay strictly between 0 and 1.

    All groups fly at once. Each round takes the open rows of a group by
    threes; the direction (w2 - w3, w3 - w1, w1 - w2) keeps both the sum of
    probabilities and of probability times words, and a step to either bound,
    drawn so that the expectation stays, closes at least one of the three.
    Two rows of equal words, left alone, can still move against each other.
    """
    p = probability.astype(float)
    order = np.lexsort((seed, group))
    for turn in range(10_000):
        live = order[(p[order] > 0) & (p[order] < 1)]
        if not len(live):
            break
        g = group[live]
        first = np.r_[True, g[1:] != g[:-1]]
        start = np.flatnonzero(first)
        at = np.arange(len(live)) - np.repeat(start, np.diff(np.r_[start, len(live)]))
        left = np.repeat(np.diff(np.r_[start, len(live)]), np.diff(np.r_[start, len(live)]))
        head = np.flatnonzero((at % 3 == 0) & (at + 2 < left))
        a, b, c = live[head], live[head + 1], live[head + 2]
        x, y, z = words[a].astype(float), words[b].astype(float), words[c].astype(float)
        u = np.stack([y - z, z - x, x - y], 1)
        u[(u == 0).all(1)] = (1, -1, 0)
        rows = np.stack([a, b, c], 1)
        pair = np.flatnonzero((at == 0) & (left == 2))
        pair = pair[words[live[pair]] == words[live[pair + 1]]]
        if len(pair):
            rows = np.r_[rows, np.stack([live[pair], live[pair + 1], live[pair + 1]], 1)]
            u = np.r_[u, np.tile([1.0, -1.0, 0.0], (len(pair), 1))]
        if not len(rows):
            break
        q = p[rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf))
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf))
        draw = mix(seed[rows[:, 0]].view(np.uint64) + np.uint64((turn * 0x9E3779B97F4A7C15 + 1) % 2**64)).astype(float) / 2.0**64
        most_up, most_down = up.min(1), down.min(1)
        rises = draw * (most_up + most_down) < most_down
        step = np.where(rises, most_up, -most_down)
        new = q + u * step[:, None]
        closing = np.where(rises[:, None], up <= most_up[:, None], down <= most_down[:, None])
        new = np.where(closing, np.where((u > 0) == rises[:, None], 1.0, 0.0), new)
        new[np.abs(new) < 1e-12] = 0.0
        new[np.abs(1 - new) < 1e-12] = 1.0
        held = (rows[:, 1] == rows[:, 2])[:, None] & np.array([[False, False, True]])
        p[rows[~held]] = new[~held]
    return p


def land(p: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The open rows, two at most, set to 0 or 1: nearest in documents first, then in words."""
    live = np.flatnonzero((p > 0) & (p < 1))
    ways = np.array([[way >> i & 1 for i in range(len(live))] for way in range(1 << len(live))], float).reshape(1 << len(live), len(live))
    documents = np.abs(ways.sum(1) - p[live].sum())
    tokens = np.abs((ways - p[live]) @ words[live].astype(float))
    out = p.copy()
    out[live] = ways[np.lexsort((tokens, np.round(documents, 9)))[0]]
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for rows (source, size).

    Weights go by code point order of the sources, null last. A target is
    weight times one level, or ``most`` times the source's size where that is
    less; the level makes the targets sum to ``share`` of all sizes. The
    windows without partitions run over one row for each source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    # The level if the sources before this one, by ratio, are at their most and this and all after it are not.
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(whole) - most * before) / after)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return rows.withColumn("level", level).select(
        "source", "source_size", F.least(most * F.col("source_size").cast("double"), F.coalesce(F.col("weight") * F.col("level"), most * F.col("source_size").cast("double"))).alias("target")
    )


def rounds(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (source, words, p, seed and others) with p set to 0 or 1.

    The first round deals all rows by their seed into blocks of all sources;
    a block leaves two open rows of each source at most. The next deal these
    by source and seed, and the last lands them. Each round's rows are written
    to the checkpoint folder, so a lost executor costs one round at most.
    """
    schema = rows.schema

    def fly(last: bool):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows[schema.names].sort_values(["seed", "words"], kind="stable").reset_index(drop=True)
            group = pd.factorize(rows["source"], use_na_sentinel=False)[0]
            words = rows["words"].to_numpy()
            p = flight(rows["p"].to_numpy(), words, group, rows["seed"].to_numpy())
            if last:
                for g in np.unique(group[(p > 0) & (p < 1)]):
                    own = group == g
                    p[own] = land(p[own], words[own])
            return rows.assign(p=p)

        return run

    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod("seed", F.lit(blocks))).groupBy("block")
    done = []
    while True:
        out = cut(dealt.applyInPandas(fly(blocks == 1), schema))
        if blocks == 1:
            done.append(out)
            break
        done.append(out.filter("p = 0 or p = 1"))
        blocks = -(-2 * blocks // (4 * block_rows))
        key = F.pmod(F.xxhash64("seed"), F.lit(blocks))
        dealt = out.filter("p > 0 and p < 1").withColumn("block", key).groupBy("source", "block")
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, size=None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies times size), a row for each of ``docs``.

    Null and empty texts have size 0; a null source is a source of its own, the
    last in order; a source of size 0 has target 0 and is not taken. Equal rows
    (doc_id, source, size) share one decision, their words counted together.
    Blocks and draws follow hashes of the rows, so reruns agree. Other columns
    are not read.
    """
    sized = cut(docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size")))
    goal = cut(targets(sized, weights, share, most))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        sized.groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(goal.withColumn("__source", F.col("source")).drop("source"), F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("times", times)
        .select(
            "doc_id", "source", "size", "n", F.floor("times").alias("base"),
            (F.col("size") * F.col("n")).alias("words"),
            (F.col("times") - F.floor("times")).alias("p"),
            F.xxhash64("doc_id", "source", "size").alias("seed"),
        )
    )
    chosen = rounds(cut(units)).select("doc_id", "source", "size", (F.col("base") + F.col("p")).cast("long").alias("copies"))
    a, b, c = sized.alias("a"), chosen.alias("b"), goal.alias("c")
    return (
        a.join(b, F.expr("a.doc_id <=> b.doc_id and a.source <=> b.source and a.size = b.size"))
        .join(c, F.expr("a.source <=> c.source"))
        .select("a.doc_id", "a.source", "a.size", "c.source_size", "c.target", "b.copies", (F.col("b.copies") * F.col("a.size")).alias("taken"))
    )


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as it is taken."""
    names = docs.columns
    copies = mix_sources(docs, weights, share, most).select("doc_id", "source", "size", "copies").distinct()
    a, b = docs.withColumn("__size", word_count(F.col("text"))).alias("a"), copies.alias("b")
    return (
        a.join(b, F.expr("a.doc_id <=> b.doc_id and a.source <=> b.source and a.__size = b.size"))
        .filter("b.copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("b.copies"))))
        .select(*(F.col(f"a.`{n}`") for n in names))
    )
