"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised (A-Z lower-cased, every other ASCII character than a
letter or digit taken as a separator) byte by byte, so that an offset in the
normalised text is the same offset in the original. The automaton holds the
windows of ten consecutive words of the test items and reads each text once.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import slices

WINDOW = 10
#: Bytes of test items in one automaton. More items are read in blocks, one automaton and one pass each.
BLOCK_BYTES = 256 << 10

#: By byte: lower case for A-Z, itself for 0-9, a-z and all above ASCII, else a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

HITS = "id {0}, n_words long, word_spans array<struct<first:long,last:long>>, byte_spans array<struct<start:long,end:long>>, items array<string>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows(items: list[tuple[str, str | None]], n: int) -> dict[str, list[str]]:
    """Item ids by window; the windows as words between single spaces, with one at either end."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - n + 1) if words else 0):
            found.setdefault(f" {b' '.join(words[i : i + n]).decode('latin-1')} ", set()).add(item)
    return {k: sorted(v) for k, v in found.items()}


def merged(spans: np.ndarray) -> np.ndarray:
    """Closed spans of integers, sorted and joined where they touch or overlap."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > ends[:-1] + 1]
    return np.c_[spans[new, 0], ends[np.r_[new[1:], True]]]


def scan(rows: DataFrame, patterns: dict[str, list[str]], kind: str) -> DataFrame:
    """Word and byte spans that the automaton of ``patterns`` hits in each text."""

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for window, items in patterns.items():
            automaton.add_word(window, (window.count(" ") - 1, items))
        if patterns:
            automaton.make_automaton()
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode().translate(NORMAL)
                words = raw.split()
                spaced = f" {b' '.join(words).decode('latin-1')} "
                hits = list(automaton.iter(spaced)) if patterns and words else []
                if not hits:
                    out.append((len(words), [], [], []))
                    continue
                spaces = np.flatnonzero(np.frombuffer(spaced.encode("latin-1"), np.uint8) == 32)
                last = np.searchsorted(spaces, [end for end, _ in hits]) - 1
                spans = merged(np.c_[last - [n - 1 for _, (n, _) in hits], last])
                is_word = np.frombuffer(raw, np.uint8) != 32
                starts = np.flatnonzero(is_word & ~np.r_[False, is_word[:-1]])
                ends = np.flatnonzero(is_word & ~np.r_[is_word[1:], False]) + 1
                items = sorted({i for _, (_, found) in hits for i in found})
                out.append((
                    len(words),
                    [{"first": a, "last": b} for a, b in spans.tolist()],
                    [{"start": int(starts[a]), "end": int(ends[b])} for a, b in spans.tolist()],
                    items,
                ))
            counts, word_spans, byte_spans, items = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(counts, pa.int64()),
                    pa.array(word_spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array(byte_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["id", "n_words", "word_spans", "byte_spans", "items"],
            )

    return rows.mapInArrow(run, HITS.format(kind))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, word_spans, byte_spans (offsets in the original's UTF-8) and items.

    Null and empty texts have no words and no hits; null or empty items have
    no windows; equal item ids count as one item; an empty benchmark hits
    nothing. Only the ids and texts are read, so other columns can't clash.
    A benchmark over ``block_bytes`` is read in blocks, never as a whole. The
    first pass gives the rows; hits of the others come to them by a 64-bit hash
    of id and text, so rows with equal or null ids are told apart.
    """
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    tests = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        rows = rows.select(F.struct("id", F.xxhash64("id", "text").alias("key")).alias("id"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    passes = []
    for block in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else tests
        passes.append(scan(rows, windows([tuple(r) for r in part.toArrow().to_pandas().itertuples(index=False)], window), kind))
    if blocks == 1:
        return passes[0].withColumnRenamed("id", "doc_id")
    spans = F.arrays_zip("word_spans", "byte_spans")
    hits = reduce(DataFrame.unionByName, (p.filter("size(items) > 0").select(F.col("id.key").alias("key"), F.lit(i).alias("pass"), spans.alias("spans"), "items") for i, p in enumerate(passes[1:])))
    once = hits.groupBy("key", "pass").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))  # equal rows have equal hits
    more = once.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
    found = passes[0].select("id.id", "id.key", "n_words", spans.alias("spans"), "items").join(more, "key", "left")
    both = lambda a, b: F.concat(a, F.coalesce(b, F.slice(a, 1, 0)))
    return found.withColumn("spans", joined(both(F.col("spans"), F.col("more_spans")))).select(
        F.col("id").alias("doc_id"), "n_words",
        F.transform("spans", lambda s: s["word_spans"]).alias("word_spans"), F.transform("spans", lambda s: s["byte_spans"]).alias("byte_spans"),
        F.array_sort(F.array_distinct(both(F.col("items"), F.col("more_items")))).alias("items"),
    )


def joined(spans):
    """Word spans with their byte spans from several passes, sorted and joined where their words overlap or touch."""

    def add(kept, span):
        top = F.get(kept, F.size(kept) - 1)
        w, b = top["word_spans"], top["byte_spans"]
        more_w, more_b = span["word_spans"], span["byte_spans"]
        one = F.struct(
            F.struct(w["first"].alias("first"), F.greatest(w["last"], more_w["last"]).alias("last")).alias("word_spans"),
            F.struct(b["start"].alias("start"), F.greatest(b["end"], more_b["end"]).alias("end")).alias("byte_spans"),
        )
        touches = (F.size(kept) > 0) & (w["last"] + 1 >= more_w["first"])
        return F.when(touches, F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(kept, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def digest(found: DataFrame) -> DataFrame:
    """The counts and digest that a report needs of ``contamination``'s rows."""
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text holds a window of a test item; all columns are kept.

    A row goes by its own text: the automaton's rows carry a 64-bit hash of the
    id and text, so rows with equal or null ids are told apart.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    hit = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, window).filter(F.size("items") > 0).select(F.col("doc_id").alias("__key"))
    return docs.withColumn("__key", key).join(hit.distinct(), "__key", "left_anti").drop("__key")
