"""URL filters: given rules first, then association rules mined from the labels these give.

Spark's FP-growth mines combinations of URL tokens that go with a label; rules
are pruned by confidence, support and by simpler rules that say the same, and
matched through an inverted index on each rule's rarest token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut

#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
MAX_TOKENS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for what has no ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of rule and verdict, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: all labels of the host from its right end by place, path segments with numbers as one token, extension, query keys, fragment."""
    labels = F.reverse(F.split(host, "\\."))
    places = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), x))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    general = F.transform(segments, lambda s: F.concat(F.lit("path:"), F.regexp_replace(F.regexp_replace(s, "\\.[A-Za-z]+$", ""), "[0-9]+", "0")))
    extension = F.regexp_extract(path, "(\\.[A-Za-z]+)$", 1)
    keys = F.transform(F.regexp_extract_all(F.regexp_extract(url, "\\?([^#]*)", 1), F.lit("([^&=]+)=[^&]*"), F.lit(1)), lambda k: F.concat(F.lit("query:"), k))
    rest = F.filter(F.array(F.when(extension != "", F.concat(F.lit("ext:"), extension)), F.when(url.contains("#"), F.lit("fragment"))), lambda x: x.isNotNull())
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(places, general, keys, rest)))


def token_classes(tokens: DataFrame) -> DataFrame:
    """token and its class, the least token that the same of ``tokens`` (tokens) hold.

    Tokens of one class make the same rules. They are mined as one, or a
    template with many fixed tokens would give a rule for each of its subsets.
    """
    sets = tokens.select("tokens").distinct().select("tokens", F.xxhash64("tokens").alias("set"))
    covers = sets.select("set", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set")).alias("cover"))
    names = covers.groupBy("n", "cover").agg(F.min("token").alias("class"))
    return covers.join(names, ["n", "cover"]).select("token", "class")


def in_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (key, tokens) of distinct keys with the classes of their tokens instead; tokens without a class are left out."""
    return rows.select("key", F.explode("tokens").alias("token")).join(classes, "token").groupBy("key").agg(F.array_sort(F.collect_set("class")).alias("tokens"))


def mine(tokens: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """rule_id, tokens, verdict, confidence and support of rules from ``tokens`` (tokens, verdict), all of its rows."""
    baskets = tokens.select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    if baskets.isEmpty():
        return tokens.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = cut(
        model.associationRules.filter(F.col("consequent")[0].startswith("verdict:") & (F.size("antecedent") <= max_tokens))
        .filter(~F.exists("antecedent", lambda t: t.startswith("verdict:")))
        .select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 9, 99).alias("verdict"), "confidence", "support")
    )
    # A rule goes if one with some of its tokens says the same with no less confidence.
    a, b = rules.select("*", F.explode("tokens").alias("token")).alias("a"), rules.select("*", F.explode("tokens").alias("token")).alias("b")
    same = F.expr("a.token = b.token and a.verdict = b.verdict and size(a.tokens) > size(b.tokens) and b.confidence >= a.confidence")
    said = a.join(b, same).filter("size(array_except(b.tokens, a.tokens)) = 0").select(F.col("a.tokens").alias("tokens"), F.col("a.verdict").alias("verdict")).distinct()
    return rules.join(said, ["tokens", "verdict"], "left_anti").withColumn("rule_id", F.xxhash64("tokens", "verdict")).select("rule_id", "tokens", "verdict", "confidence", "support")


def match(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """key, verdict and mined (the rule's tokens) for rows (key, tokens) that a rule fits; the most confident, then best supported, wins."""
    rarity = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (
        rules.select("*", F.explode("tokens").alias("token")).join(rarity, "token")
        .groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
        .join(rules, "rule_id")
    )
    best = F.struct(-F.col("r.confidence"), -F.col("r.support"), F.size("r.tokens"), F.col("r.rule_id"))
    return (
        tokens.select("key", "tokens", F.explode("tokens").alias("token")).alias("t")
        .join(index.alias("r"), F.expr("t.token = r.token"))
        .filter("size(array_except(r.tokens, t.tokens)) = 0")
        .groupBy("t.key").agg(F.min_by(F.struct("r.verdict", "r.tokens"), best).alias("best"))
        .select("key", F.col("best.verdict").alias("verdict"), F.array_join("best.tokens", " & ").alias("mined"))
    )


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (what decided if no given rule fits), a row for each of ``pages``.

    Null urls, and urls without ``://``, have an empty host and path, no tokens,
    and get ``default``, as do urls that no rule of either kind fits. Very long
    urls are read whole. Of given rules that fit the longest wins; of mined ones
    the most confident, then the best supported, the shortest, and the one of
    the least hash. Equal urls are judged alike, each row once. Other columns
    are not read. ``mined`` names one token for all that occur with it always.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).withColumn("fit", rule_column(F.col("host"), F.col("path"), rules))
    # What the verdict hangs on is the token set: each is judged once.
    rows = cut(rows.withColumn("tokens", F.array_sort(url_tokens(F.col("url"), F.col("host"), F.col("path")))).withColumn("key", F.xxhash64("tokens")).drop("url"))
    labelled = rows.filter("fit is not null")
    classes = cut(token_classes(labelled))
    named = in_classes(labelled.select("key", "tokens").distinct(), classes)
    mined = mine(labelled.join(named.withColumnRenamed("tokens", "named"), "key", "left").select(F.coalesce("named", F.array().cast("array<string>")).alias("tokens"), F.col("fit.verdict").alias("verdict")), min_support, min_confidence)
    open_sets = rows.filter("fit is null and size(tokens) > 0").select("key", "tokens").distinct()
    found = match(in_classes(open_sets, classes), mined).select(F.col("key").alias("k"), F.col("verdict").alias("learnt"), "mined")
    return rows.join(found, F.expr("key = k and fit is null"), "left").select(
        "page_id", "host", "path", "fit.rule", F.coalesce("fit.verdict", "learnt", F.lit(default)).alias("verdict"), "mined"
    )
