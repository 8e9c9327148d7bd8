"""Toxicity from averaged subword embeddings and a linear softmax.

A word is the bag of its own vector and those of its character n-grams, so a
misspelling that was never seen shares most of them. A window's vectors are
averaged into two logits; embeddings and weights are trained jointly in numpy.
A document is as toxic as its most toxic window, and all windows are read.
Since labels hold for documents, training goes back and forth: windows of
toxic documents that score highest are taken as toxic, and the model is
trained anew on them against windows of clean documents, the hardest included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import hash_words, mix, slices, words_of

WINDOW = 12
BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4, 5)
ROUNDS = 2
STEPS = 50
RATE = 0.2
TEXTS_AT_ONCE = 100
#: Most labelled documents of each class that the model is fitted on: about so many, drawn by a hash of doc_id.
SAMPLE = 2000


def subwords(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of each word's own entry and of the n-grams of ``<word>``, in the words' order."""
    n = len(distinct)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in distinct.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    word = np.repeat(np.arange(n), lengths)
    buckets, owners = [hash_words(distinct) % np.uint64(BUCKETS)], [np.arange(n)]
    for size in GRAMS:
        count = len(points) - size + 1
        if count <= 0:
            continue
        inside = word[:count] == word[size - 1 :]
        total = np.full(count, size, np.uint64)
        for i in range(size):
            total = mix(total * np.uint64(0x100000001B3) + points[i : i + count])
        buckets.append(total[inside] % np.uint64(BUCKETS))
        owners.append(word[:count][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), owner[order]


@dataclass
class Bags:
    """Windows of texts: the distinct words' subwords, and each window's words."""

    bucket: np.ndarray  # of each subword of each word
    word_start: np.ndarray
    code: np.ndarray  # of each word of each window
    window_start: np.ndarray
    row: np.ndarray  # the text of each window

    @property
    def subword_counts(self) -> np.ndarray:
        return np.diff(np.r_[self.word_start, len(self.bucket)])


def bags(texts: pa.Array) -> Bags:
    """Windows of WINDOW words; the last one of a text may be shorter, and a text without words has none."""
    offsets, codes, distinct = words_of(pc.utf8_lower(pc.fill_null(texts, "")))
    bucket, owner = subwords(distinct)
    counts = np.diff(offsets)
    each = -(-counts // WINDOW)
    row = np.repeat(np.arange(len(counts)), each)
    at = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    return Bags(bucket, np.searchsorted(owner, np.arange(len(distinct))), codes.astype(np.int64), offsets[:-1][row] + at * WINDOW, row)


def add_runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0) if len(starts) else np.zeros((0, *values.shape[1:]), values.dtype)


@dataclass
class Model:
    """value: each bucket's share of the logit (embedding times softmax weights, class 1 less class 0); bias: a window's."""

    value: np.ndarray
    bias: float

    def logits(self, b: Bags) -> np.ndarray:
        if not len(b.window_start):
            return np.zeros(0)
        words = add_runs(self.value[b.bucket], b.word_start)
        total = add_runs(words[b.code], b.window_start)
        return total / add_runs(b.subword_counts[b.code], b.window_start) + self.bias

    def document_logits(self, b: Bags, rows: int) -> np.ndarray:
        """Each text's highest window; the bias for texts without words."""
        out = np.full(rows, -np.inf)
        np.maximum.at(out, b.row, self.logits(b))
        return np.where(np.isinf(out), min(self.bias, 0.0), out)


def chosen(b: Bags, windows: np.ndarray) -> Bags:
    """Only these windows, and the words they have."""
    ends = np.r_[b.window_start[1:], len(b.code)]
    lengths = (ends - b.window_start)[windows]
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(b.window_start[windows] - starts, lengths) + np.arange(lengths.sum())
    used, code = np.unique(b.code[at], return_inverse=True)
    counts = b.subword_counts[used]
    begin = np.cumsum(counts) - counts
    bucket = b.bucket[np.repeat(b.word_start[used] - begin, counts) + np.arange(counts.sum())]
    return Bags(bucket, begin, code, starts, b.row[windows])


def fit_windows(b: Bags, toxic: np.ndarray, seed: int) -> Model:
    """Embeddings and softmax weights fitted to windows by Adam over all of them at each step; classes weigh alike."""
    draw = np.random.default_rng(seed)
    used, local = np.unique(b.bucket, return_inverse=True)
    embedding = draw.normal(0, 0.1, (len(used), DIMENSIONS)).astype(np.float32)
    weights, bias = draw.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    counts = b.subword_counts
    size = add_runs(counts[b.code], b.window_start).astype(np.float32)[:, None]
    lengths = np.diff(np.r_[b.window_start, len(b.code)])
    window_of = np.repeat(np.arange(len(lengths)), lengths)
    by_code = np.argsort(b.code, kind="stable")
    code_start = np.searchsorted(b.code[by_code], np.arange(len(counts)))
    word_of = np.repeat(np.arange(len(counts)), counts)
    by_bucket = np.argsort(local, kind="stable")
    bucket_start = np.searchsorted(local[by_bucket], np.arange(len(used)))
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))[:, None].astype(np.float32)
    truth = np.stack([~toxic, toxic], 1).astype(np.float32)
    values = [embedding, weights, bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, STEPS + 1):
        embedding, weights, bias = values
        words = add_runs(embedding[local], b.word_start)
        mean = add_runs(words[b.code], b.window_start) / size
        logit = mean @ weights + bias
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(1, keepdims=True)
        slope = (p - truth) * share
        to_mean = slope @ weights.T / size
        to_words = add_runs(to_mean[window_of[by_code]], code_start)
        slopes = [add_runs(to_words[word_of[by_bucket]], bucket_start) + 1e-6 * embedding, mean.T @ slope + 1e-5 * weights, slope.sum(0)]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            values[i] = values[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + np.float32(1e-10))
    embedding, weights, bias = values
    value = np.zeros(BUCKETS)
    value[used] = embedding @ (weights[:, 1] - weights[:, 0])
    return Model(value, float(bias[1] - bias[0]))


def log_odds(b: Bags, toxic: np.ndarray) -> Model:
    """A first guess at windows: each bucket's smoothed log odds between toxic and clean texts that hold it."""
    lengths = np.diff(np.r_[b.window_start, len(b.code)])
    text = np.repeat(b.row, lengths)
    hot, cold = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for first in range(0, len(toxic), TEXTS_AT_ONCE):  # a text's subwords are many times its words
        begin, end = np.searchsorted(text, [first, first + TEXTS_AT_ONCE])
        pairs = np.unique(text[begin:end] * np.int64(len(b.word_start)) + b.code[begin:end])
        row, word = pairs // len(b.word_start), pairs % len(b.word_start)
        counts = b.subword_counts[word]
        before = np.cumsum(counts) - counts
        bucket = b.bucket[np.repeat(b.word_start[word] - before, counts) + np.arange(counts.sum())]
        seen = np.unique(np.repeat(row, counts) * np.int64(BUCKETS) + bucket)
        held = toxic[seen // BUCKETS]
        hot += np.bincount(seen[held] % BUCKETS, minlength=BUCKETS)
        cold += np.bincount(seen[~held] % BUCKETS, minlength=BUCKETS)
    return Model(np.log((hot + 1) / (toxic.sum() + 2)) - np.log((cold + 1) / ((~toxic).sum() + 2)), 0.0)


def fit(texts: list[str | None], labels: list[int], rounds: int = ROUNDS) -> Model:
    """A model from labelled texts, its bias set where held-back texts part best; a constant one if a class is missing."""
    toxic = np.array(labels, int) == 1
    empty = Model(np.zeros(BUCKETS), float(np.log((toxic.sum() + 0.5) / ((~toxic).sum() + 1.5))))
    b = bags(pa.array(texts, pa.string()))
    back = np.arange(len(texts)) % 5 == 4  # sets the bias only
    if not len(b.row) or not toxic[b.row].any() or toxic[b.row].all():
        return empty
    model = log_odds(b, toxic & ~back)
    draw = np.random.default_rng(7)
    trained = ~back[b.row]
    for turn in range(rounds):
        logit = model.logits(b)
        order = np.lexsort((-logit, b.row))
        first = np.r_[True, b.row[order][1:] != b.row[order][:-1]]
        rank = np.empty(len(order), np.int64)
        start = np.flatnonzero(first)
        rank[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        bad = toxic[b.row] & (rank == 0)
        good = ~toxic[b.row] & ((rank < 2) | (draw.random(len(rank)) < 0.1))
        windows = np.flatnonzero(trained & (bad | good))
        if not toxic[b.row[windows]].any() or toxic[b.row[windows]].all():
            return empty
        own = chosen(b, windows)
        model = fit_windows(own, toxic[own.row], turn)
    score = model.document_logits(b, len(texts))
    apart = back if toxic[back].any() and (~toxic[back]).any() else np.ones(len(texts), bool)
    order = np.argsort(score[apart], kind="stable")
    s, t = score[apart][order], toxic[apart][order]
    # Missed toxic texts plus wrongly accused clean ones, the latter with four times the weight, if the cut is below place i.
    wrong = np.r_[0, np.cumsum(t) / t.sum()] + 4 * np.r_[(~t)[::-1].cumsum()[::-1], 0] / (~t).sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    i = int(best[len(best) // 2])
    low, high = (s[i - 1] if i else s[0] - 1), (s[i] if i < len(s) else s[-1] + 1)
    cut = (low + high) / 2
    return Model(model.value, model.bias - float(cut))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of about ``sample`` documents of each class outside the held-out fold, all if there are fewer.

    Rows are drawn by a hash of doc_id, alike at every size. A document with
    several labels is toxic if one says so; null labels and ids don't count.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(fold(F.col("doc_id")) != 0)
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").agg(F.count(F.lit(1))).collect()}  # two rows
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for label, n in sizes.items():
        keep = keep | ((F.col("toxic") == label) & (place < sample / n))
    # At most about sample ids of each class: small whatever the data.
    return docs.select("doc_id", "text").join(F.broadcast(known.filter(keep)), "doc_id").select("doc_id", "text", "toxic")


def fit_sample(rows: DataFrame) -> Model:
    """``fit`` on an executor, where there is room for it; ``rows`` are bounded by the sample."""

    def run(batches):
        held = sorted((r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "toxic")), strict=True)), key=lambda r: (r[0], r[1] or ""))
        model = fit([r[1] for r in held], [r[2] for r in held])
        yield pa.RecordBatch.from_arrays([pa.array([model.value.tobytes()]), pa.array([model.bias])], names=["value", "bias"])

    found = rows.repartition(1).mapInArrow(run, "value binary, bias double").first()
    return Model(np.frombuffer(found[0], np.float64), found[1]) if found else fit([], [])


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each of ``docs``.

    Null and empty texts get the bias alone, and never 1. Very long texts are
    read whole, window by window, and have the score of their worst one. A row
    without doc_id is not held out. Repeated rows get equal scores, each of
    them; a score of exactly 0.5 is predicted 1. Other columns are not read, so
    their names can't clash.
    """

    def run(batches):
        for batch in slices(batches):
            logit = model.document_logits(bags(batch.column("text")), batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for each of ``docs``, by a model of ``labels`` (doc_id, toxic) outside the held-out fold.

    The model is fitted on about ``sample`` documents of each class, all if
    there are fewer, drawn by a hash of doc_id, so reruns agree. Labels that are
    null, or of no document, don't count; a document labelled both ways is
    toxic. Without labels of either class all scores are alike, and without
    documents there are none. Rows are scored as ``score_texts`` says.
    """
    return score_texts(docs, fit_sample(labelled_sample(docs, labels, sample)))
