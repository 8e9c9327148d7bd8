"""Token counts without token ids.

Pre-tokens are counted over all texts first, and each distinct one is encoded
once. Its number of pieces is then joined to its frequency in every document
and summed. A table of the most frequent ones, of a fixed size at most, is sent
to the documents, so that no pre-token left is a hot key; rows of all others are
shuffled to their counts, at every size of the corpus. Both ways compare the
strings themselves.

Texts are cut into units first, runs of characters after a run of spaces and
line feeds. No pre-token reaches over such a cut, and units repeat, so the
pre-token pattern is applied once to each distinct unit of a slice.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, slices

#: Fixed value: the published pre-token pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Of the distinct pre-tokens, the most frequent one in SHARE is in the table that is sent to the documents, SENT at most.
SENT, SHARE = 1 << 18, 8
UNIT = re.compile("[ \n]*[^ \n]+|[ \n]+")
#: Where a cut would part a run of white space.
ODD = re.compile(r"[^\S \n][ \n]")
#: From here on character classes differ between the Unicode versions of libraries.
NEWER = re.compile("[԰-\U0010ffff]")


class Cutter:
    """Cuts texts into pre-tokens by the rules of a tokenizer, given as its JSON."""

    def __init__(self, rules: str):
        import regex

        self.rules, self.library = rules, None
        special = sorted((t["content"] for t in json.loads(rules).get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.find = regex.compile(PATTERN).findall

    def units(self, text: str) -> tuple[list[str], int]:
        """The text's units, and its number of special tokens."""
        parts = self.special.split(text) if self.special else [text]
        return [u for part in parts for u in ((part,) if ODD.search(part) else UNIT.findall(part)) if u], len(parts) - 1

    def pre_tokens(self, unit: str) -> list[str]:
        if not NEWER.search(unit):
            return self.find(unit)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.rules).pre_tokenizer
        return [unit[a:b] for _, (a, b) in self.library.pre_tokenize_str(unit)]


def frequencies(rows: DataFrame, rules: str) -> DataFrame:
    """(piece, times): each distinct pre-token of all texts and how often they have it."""

    def run(batches):
        cutter = Cutter(rules)
        for batch in slices(batches):
            units: Counter = Counter()
            for text in batch.column("text").to_pylist():
                units.update(cutter.units(text or "")[0])
            pieces: Counter = Counter()
            for unit, n in units.items():
                for p in cutter.pre_tokens(unit):
                    pieces[p] += n
            yield pa.RecordBatch.from_arrays([pa.array(pieces.keys(), pa.string()), pa.array(pieces.values(), pa.int64())], names=["piece", "times"])

    return rows.select("text").mapInArrow(run, "piece string, times long").groupBy("piece").agg(F.sum("times").alias("times"))


def encoded(pieces: DataFrame, rules: str) -> DataFrame:
    """(piece, times, n): how many tokens each distinct pre-token has; each is encoded once."""

    def run(batches):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(rules)
        for batch in slices(batches, "piece"):
            n = [len(e) for e in tokenizer.encode_batch(batch.column("piece").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("times"), pa.array(n, pa.int64())], names=["piece", "times", "n"])

    return pieces.mapInArrow(run, "piece string, times long, n long")


def most_frequent(pieces: DataFrame, most: int) -> dict[str, int]:
    """The most frequent pieces, one in SHARE and ``most`` at most, with their numbers of tokens: all with a frequency above some bound."""
    bucket = F.floor(F.log2("times") * 8)  # a few hundred, whatever the data
    sizes = sorted(pieces.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    held, least = 0, None
    most = min(most, sum(n for _, n in sizes) // SHARE)
    for b, n in sizes:
        held += n
        if held > most:
            break
        least = b
    return {} if least is None else {r.piece: r.n for r in pieces.filter(bucket >= least).select("piece", "n").collect()}


def summed(rows: DataFrame, table: dict[str, int], rules: str) -> DataFrame:
    """A row for each of ``rows`` (id, key, text): id, key, n_bytes, known (tokens of special strings and of pre-tokens in ``table``), and rest, the pre-tokens that aren't there with how often the text has them, packed; of a task's copies the first has the rest."""

    def run(batches):
        cutter = Cutter(rules)
        seen: set[int] = set()  # copies of a text give its rest once
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            units, special = zip(*map(cutter.units, texts), strict=True)
            ends = np.cumsum([len(u) for u in units])
            coded = pa.array(chain.from_iterable(units), pa.string()).dictionary_encode()
            codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            pieces = [cutter.pre_tokens(u) for u in distinct]
            of = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
            flat = list(chain.from_iterable(pieces))
            numbers = np.array([table.get(p, 0) for p in flat], np.int64)  # a pre-token has one token at least
            there = numbers > 0
            worth = np.bincount(of, numbers, len(distinct)) if len(distinct) else np.zeros(0)
            total = np.r_[0, np.cumsum(worth[codes])][np.r_[0, ends]]
            known = np.diff(total).astype(np.int64) + np.array(special)
            lacking: dict[int, list[str]] = {}
            for i in np.flatnonzero(~there).tolist():
                lacking.setdefault(int(of[i]), []).append(flat[i])
            rest: list[bytes | None] = [None] * len(texts)
            if lacking:
                keys = batch.column("key").to_pylist()
                places = np.flatnonzero(np.isin(codes, list(lacking)))
                by_text: dict[int, Counter] = {}
                for row, code in zip(np.searchsorted(ends, places, "right").tolist(), codes[places].tolist(), strict=True):
                    by_text.setdefault(row, Counter()).update(lacking[code])
                for row, counts in by_text.items():
                    if keys[row] not in seen:
                        seen.add(keys[row])
                        rest[row] = zlib.compress(json.dumps(counts).encode(), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(known), pa.array(rest, pa.binary())],
                names=["id", "key", "n_bytes", "known", "rest"],
            )

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, key long, n_bytes long, known long, rest binary")


def unpacked(rest: DataFrame) -> DataFrame:
    """(key, piece, of) of rows (key, rest)."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                counts = [json.loads(zlib.decompress(x)) for x in part.column("rest").to_pylist()]
                keys = np.repeat(part.column("key").to_numpy(), [len(c) for c in counts])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(chain.from_iterable(counts), pa.string()), pa.array(chain.from_iterable(c.values() for c in counts), pa.int64())], names=["key", "piece", "of"])

    return rest.mapInArrow(run, "key long, piece string, of long")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text", sent: int = SENT) -> DataFrame:
    """``id``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for each row.

    Null and empty texts have 0 bytes and 0 tokens; very long texts are counted
    whole, each in a slice of its own; repeated rows are counted each; texts
    with ``limit`` tokens are not over it; other columns are not read, so their
    names can't clash. The tokenizer's file is read by the driver only. Of the
    distinct pre-tokens the ``sent`` most frequent at most are sent to the
    documents; the rest are joined, at every size of the corpus.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        rules = file.read()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("key", F.xxhash64("text"))
    pieces = cut(encoded(frequencies(rows, rules), rules))
    found = cut(summed(rows, most_frequent(pieces, sent), rules))
    every, rest = found.select("id", "key", "n_bytes", "known"), unpacked(found.filter("rest is not null").select("key", "rest").dropDuplicates(["key"]))
    more = rest.join(pieces.select("piece", "n"), "piece").groupBy("key").agg(F.sum(F.col("of") * F.col("n")).alias("more"))
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return every.join(more, "key", "left").select(F.col("id").alias(id_column), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
