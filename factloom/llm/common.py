"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.checkpoints import shared_folder

#: Bytes of text that a worker handles at once.
SLICE_BYTES = 4 << 20
#: Words of 64 bits in the filter of rows that a step asks for.
FILTER_WORDS = 1 << 17
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder.

    What only the cut lineage needed, shuffle files above all, is let go at
    once: Spark removes it when the driver's garbage is collected, and small
    drivers of long chains collect too seldom.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint()
    gc.collect()
    context._jvm.System.gc()
    return out


def asked_for(rows: DataFrame, keys: DataFrame, flag: str | None = None, key: str = "key") -> DataFrame:
    """``rows`` whose ``key`` may be among ``keys`` (of the same name), with all that are, before any of their text is sent; with ``flag`` all rows, that column telling which.

    The filter is a table of FILTER_WORDS rows of 64 bits at most, whatever the
    data, so it can be broadcast; a fuller one lets more rows pass.
    """
    place = F.pmod(F.xxhash64(key), F.lit(64 * FILTER_WORDS))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    held = cut(keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))
    joined = rows.join(F.broadcast(held), word == F.col("__word"), "left" if flag else "inner")
    asked = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return (joined.withColumn(flag, asked) if flag else joined.filter(asked)).drop("__word", "__bits")


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], rows: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Columns of sorted batches, cut where the first column changes, of about ``rows`` rows or more.

    A group over 16 times ``rows`` comes in pieces, each with True before it.
    """
    rest: list[list] = []
    held, passing = 0, None

    def joined():
        return [np.concatenate([x[k] for x in rest]) for k in range(len(names))]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
        if passing is not None:
            end = int(np.searchsorted(new[0], passing, "right"))
            if end:
                yield True, [x[:end] for x in new]
            if end == len(new[0]):
                continue
            new, passing = [x[end:] for x in new], None
        rest.append(new)
        held += len(new[0])
        if held < rows:
            continue
        columns = joined()
        last = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        if last:
            yield False, [x[:last] for x in columns]
        rest, held = [[x[last:] for x in columns]], held - last
        if held > 16 * rows:
            passing = columns[0][-1]
            yield True, rest[0]
            rest, held = [], 0
    if held:
        yield False, joined()


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """The runs of characters other than ASCII white space; none for null."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)),
        lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t-\\r]+")),
    )


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about SLICE_BYTES of ``column``; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
        starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], len(piece)], strict=True):
            yield batch.slice(start, end - start)
    release()


def release() -> None:
    """Gives memory that a task no longer uses back: workers live on, idle ones beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words as (offsets by row, code of each word, distinct words); null has none."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    blank = pc.equal(flat, "")
    if pc.any(blank).as_py():
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        counts[empty] = 0
        flat = flat.filter(pc.invert(blank))
    codes = flat.dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    return np.r_[0, np.cumsum(counts)], codes.indices.to_numpy(zero_copy_only=False), codes.dictionary


def hash_words(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` consecutive entries, by position of its first."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for i in range(n):
        total = mix(total * factor + hashes[i : len(hashes) - n + 1 + i])
    return total
