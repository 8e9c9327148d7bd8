"""The documents of a shared corpus that say most about each claim, by an inverted index with upper bounds.

A document's score is the sum of the weights of the claim's keywords in it; rare
keywords weigh more. Each claim's rarest keywords, as many as lead to a few
documents, give a score that the last of its top documents reaches at least.
Keywords whose weights together stay below that cannot bring a document in by
themselves, so only documents with one of the others are candidates; common
keywords are looked up for candidates alone, and not for those whose score can't
reach the bound any more. Keywords in many documents are dealt by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.patterns import exploded
from factloom.sources.checkpoints import cut

#: Documents for each one asked for that a claim's rarest keywords lead to at most.
TRIED = 50
#: A keyword that has more than one of so many postings is dealt into SALTS parts: fewer such keywords than HOT exist, whatever the data.
HOT, SALTS = 1000, 64
#: Weights are whole numbers, so sums don't hang on the order of their terms.
SCALE = 10_000


def salted(postings: DataFrame, hot: DataFrame) -> DataFrame:
    """``postings`` with salt: a part of their own by document for the words of ``hot`` (HOT rows at most)."""
    marked = postings.join(F.broadcast(hot.select("word", F.lit(True).alias("__hot"))), "word", "left")
    return marked.withColumn("salt", F.when(F.col("__hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")).drop("__hot")


def looked_up(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """claim_id, doc_id, weight for each of ``terms`` (claim_id, word, weight, hot) and document with its word."""
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return terms.select("claim_id", "word", "weight", F.explode(parts).alias("salt")).join(postings, ["word", "salt"]).select("claim_id", "doc_id", "weight")


def corpus_top(claims: DataFrame, docs: DataFrame, most: int = 10) -> DataFrame:
    """claim_id, doc_id, score and rank (from 1) of the ``most`` documents with the highest scores of each claim, the lower doc_id first of equals.

    ``claims`` has claim_id and words, ``docs`` doc_id and words (arrays);
    repeated words count once. Documents that share no word with a claim aren't
    its; a claim without words has none. Weights are SCALE * ln(1 + documents /
    documents with the word), rounded. Null ids are left out.
    """
    asked = exploded(claims.filter("claim_id is not null"), ["claim_id"], F.array_distinct("words"), "word")
    of_claims = asked.select("word").distinct()
    held = exploded(docs.filter("doc_id is not null"), ["doc_id"], F.array_distinct("words"), "word").join(of_claims, "word", "left_semi").distinct()
    held = cut(held)
    total = docs.filter("doc_id is not null").select("doc_id").distinct().count()
    counts = cut(held.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    postings_total = counts.agg(F.sum("df")).first()[0] or 0
    hot = cut(counts.filter(F.col("df") * HOT > postings_total))
    weight = F.round(F.log1p(F.lit(float(total)) / F.col("df")) * SCALE).cast("long")
    terms = asked.distinct().join(counts, "word").select("claim_id", "word", "df", weight.alias("weight"), (F.col("df") * HOT > postings_total).alias("hot"))
    terms = cut(terms)
    postings = salted(held, hot)

    rarest = Window.partitionBy("claim_id").orderBy("df", "word")
    few = terms.withColumn("led", F.sum("df").over(rarest)).filter(F.col("led") <= TRIED * most)
    tried = looked_up(few, postings).groupBy("claim_id", "doc_id").agg(F.sum("weight").alias("score"))
    place = Window.partitionBy("claim_id").orderBy(F.desc("score"), "doc_id")
    last = tried.withColumn("place", F.row_number().over(place)).filter(F.col("place") == most).select("claim_id", F.col("score").alias("bound"))

    weakest = Window.partitionBy("claim_id").orderBy("weight", "word")
    bounded = cut(terms.join(last, "claim_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0))).withColumn("upto", F.sum("weight").over(weakest)))
    needed, others = bounded.filter("upto >= bound"), bounded.filter("upto < bound")
    most_of_others = others.groupBy("claim_id").agg(F.sum("weight").alias("more"), F.collect_list(F.struct("word", "weight")).alias("others"))
    some = looked_up(needed, postings).groupBy("claim_id", "doc_id").agg(F.sum("weight").alias("score"))
    bounds = bounded.groupBy("claim_id").agg(F.max("bound").alias("bound")).join(most_of_others, "claim_id", "left")
    open_pairs = some.join(bounds, "claim_id").filter(F.col("score") + F.coalesce("more", F.lit(0)) >= F.col("bound"))
    done = open_pairs.filter("others is null").select("claim_id", "doc_id", "score")
    rest = open_pairs.filter("others is not null").select("claim_id", "doc_id", "score", F.explode("others").alias("o")).select("claim_id", "doc_id", "score", "o.word", "o.weight")
    found = rest.join(held.withColumn("held", F.lit(1)), ["doc_id", "word"], "left").groupBy("claim_id", "doc_id").agg((F.first("score") + F.sum(F.when(F.col("held") == 1, F.col("weight")).otherwise(0))).alias("score"))
    ranked = done.unionByName(found).withColumn("rank", F.row_number().over(place).cast("long"))
    return ranked.filter(F.col("rank") <= most).select("claim_id", "doc_id", "score", "rank")
