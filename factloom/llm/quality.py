"""Quality rules with cross-document line frequency, in DataFrame expressions only.

A line's words are normalised and hashed; per host the distinct documents with
that line are counted; lines above the host's limit are removed, and documents
depleted by that are rejected. Rows with one id, source and text are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WHITE, cut, let, word_array

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is removed if more than so many distinct documents of its host hold it, however many the host has.
LINE_DOCUMENTS = 20
#: A document is rejected if fewer than so many of 100 words are left.
LEFT_PERCENT = 40
#: Parts into which a frequent line's documents are dealt.
SALTS = 16
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more in the array."""
    n = F.size(words)
    hashes = F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(grams: Column) -> Column:
        order = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(order, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))).cast("long")


def base_rules(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    return let(
        word_array(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(whole, WHITE, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(WHITE)), "[ \\t-\\r]+", " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def document_key() -> Column:
    """What tells rows apart: id, source and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.coalesce("source", F.lit("\x00")), F.coalesce("text", F.lit("")))


def frequent_lines(rows: DataFrame, line_documents: int) -> DataFrame:
    """key, n_removed (words) and removed (hashes of lines over the host's limit) of the documents that hold such lines.

    ``rows`` has key, host and text. Lines are cut out of the texts once; a row
    for each document and line follows, so documents are counted before any
    shuffle by line, and a line that half of a host's documents hold is no hot
    key. What joins these rows with the lines over the limit is salted.
    """
    one = lambda x: let(normal_line(x), lambda t: F.struct(F.xxhash64(t).alias("line"), F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).alias("n")))
    # An outer explode: with an inner one Spark would make all lines a second time, in a filter that there are any.
    every = rows.select("key", "host", F.explode_outer(F.transform(F.split("text", "\n"), one)).alias("one")).select("key", "host", "one.*").filter("n > 0")
    lines = cut(every.groupBy("key", "host", "line").agg(F.sum("n").alias("n")))
    documents = cut(rows.groupBy("key", "host").agg(F.count(F.lit(1)).alias("copies")))  # rows that are equal
    over = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > line_documents)
    salted = over.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = lines.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"])
    found = held.groupBy("key").agg(F.sum("n").alias("n"), F.collect_set("line").alias("removed"))
    return found.join(documents.select("key", "copies"), "key").select("key", F.expr("n div copies").alias("n_removed"), "removed")


def judged(docs: DataFrame, line_documents: int, left_percent: int) -> DataFrame:
    """``docs`` with one more column, the struct __quality."""
    rows = docs.withColumn("__key", document_key())
    removed = frequent_lines(rows.select(F.col("__key").alias("key"), F.coalesce("source", F.lit("\x00")).alias("host"), "text"), line_documents)
    r = removed.select(F.col("key").alias("__key"), F.struct("n_removed", "removed").alias("__found"))
    n, again, n_removed = F.col("__base.n_words"), F.col("__base.n_repeat_words"), F.coalesce(F.col("__found.n_removed"), F.lit(0))
    failed = (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)
    # As one comparison: of two conditions Spark would test the first below the join, and count all words again for it.
    kept = F.least(F.when(failed, -1).otherwise(0), 100 * (n - n_removed) - left_percent * n) >= 0
    quality = F.struct(
        "__base.*",
        failed.alias("base_failed"),
        n_removed.alias("n_removed"),
        kept.alias("kept"),
        F.col("__found.removed").alias("removed"),
    )
    joined = rows.withColumn("__base", base_rules(F.col("text"))).join(r, "__key", "left")
    return joined.withColumn("__quality", quality).drop("__key", "__base", "__found")


def quality_rules(docs: DataFrame, line_documents: int = LINE_DOCUMENTS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed (words in removed lines) and kept, for each row of ``docs``.

    Null and empty texts have no words, so they fail the base rules. A null
    source is a host of its own. Very long texts are judged whole; a line in
    as many documents as a limit says stays, and the limit is the same for hosts of any size. Rows are told apart by id, source
    and text: equal rows count once and get equal results, each of them. Other
    columns are not read.
    """
    found = judged(docs.select("doc_id", "text", "source"), line_documents, left_percent)
    return found.select("doc_id", "__quality.*").drop("removed")


def clean(docs: DataFrame, line_documents: int = LINE_DOCUMENTS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """The kept rows of ``docs``, all columns, without the lines above the limits; n_chars, if there, follows the text."""
    found = judged(docs, line_documents, left_percent).filter("__quality.kept")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("__quality.removed", line_hash(x))), "\n")
    out = found.withColumn("text", F.when(F.col("__quality.removed").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.drop("__quality")
