"""Results without near-copies of titles, at the scale of a whole table.

The order of arrival decides: a title stays unless an earlier one that stays is
its near-copy. Rivals share one of their rarest tokens (the longer their titles
the more of them count), so tokens make buckets. In a bucket the earliest title
that is still open is compared with all others: one that is earliest in all its
buckets has no open rival before it and stays, and its near-copies go, which
settles groups of copies in a few rounds without pairs of their members. What
is open then is paired within buckets, and a title is decided once its earlier
rivals are, round by round until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.patterns import exploded
from factloom.operators.search import opposite_meanings, title_key
from factloom.sources.checkpoints import cut

LEAST_TOKENS, PERCENT = 6, 85
#: Width of the table of token counts that orders tokens.
WIDTH = 1 << 16
#: Rounds by the earliest title of each bucket at most; they end before when one settles less than one in SETTLED of what is open.
ROUNDS, SETTLED = 16, 8


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(WIDTH)).cast("int")


def rare_tokens(items: DataFrame, percent: int) -> DataFrame:
    """``items`` with ``prefix``: so many of each title's rarest tokens that near-copies share one. The counts are one row of WIDTH numbers, whatever the data."""
    counts = exploded(items, [], F.col("tokens"), "token").groupBy(bucket_of(F.col("token")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = items.sparkSession.range(WIDTH).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("n", F.lit(0)).alias("n")))).alias("__counts")).select(F.col("__counts.n").alias("__counts"))
    size = F.size("tokens")
    most = size - F.ceil(size * percent / F.lit(100)) + 1
    order = F.array_sort(F.transform("tokens", lambda t: F.struct(F.get("__counts", bucket_of(t)).alias("n"), t.alias("t"))))
    return items.crossJoin(F.broadcast(row)).withColumn("prefix", F.slice(order["t"], F.lit(1), most.cast("int"))).drop("__counts")


def near(a: str, b: str, percent: int) -> Column:
    """Whether two token sets are alike and don't say opposite things."""
    x, y = F.col(a), F.col(b)
    both = F.size(F.array_intersect(x, y))
    alike = 100 * both >= percent * (F.size(x) + F.size(y) - both)
    return F.when(alike, ~opposite_meanings(x, y)).otherwise(False)


def settled_by_earliest(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(ids that stay, entries still open) after a round: the earliest title of each bucket against the others."""
    least = entries.groupBy("group", "token").agg(F.min("place").alias("least"))
    led = cut(entries.join(least, ["group", "token"]))
    stays = cut(led.groupBy("id").agg(F.min(F.col("place") == F.col("least")).alias("first")).filter("first").select("id"))
    centres = led.join(stays, "id", "left_semi").select("group", "token", F.col("tokens").alias("kept"))
    rest = led.join(stays, "id", "left_anti")
    goes = rest.join(centres, ["group", "token"]).filter(near("tokens", "kept", percent)).select("id").distinct()
    return stays, cut(rest.join(goes, "id", "left_anti").drop("least"))


def settled_by_rivals(entries: DataFrame, percent: int) -> DataFrame:
    """Ids that stay of the titles still open: all rivals paired, then decided once the earlier ones are."""
    sizes = entries.withColumn("n", F.size("tokens"))
    fits = F.col("x.n") * percent <= F.lit(100) * F.col("y.n")
    rivals = (
        sizes.alias("x").join(sizes.alias("y"), F.expr("x.group <=> y.group and x.token = y.token and x.place > y.place") & fits & (F.col("y.n") * percent <= F.lit(100) * F.col("x.n")))
        .select(F.col("x.id").alias("id"), F.col("y.id").alias("before"), F.col("x.tokens").alias("a"), F.col("y.tokens").alias("b"))
    )
    rivals = cut(rivals.filter(near("a", "b", percent)).select("id", "before").distinct())
    open_ids = cut(entries.select("id").distinct())
    stays = open_ids.limit(0)
    while not open_ids.isEmpty():
        waiting = rivals.join(open_ids.withColumnRenamed("id", "before"), "before", "left_semi").select("id").distinct()
        new = cut(open_ids.join(waiting, "id", "left_anti"))
        goes = rivals.join(new.withColumnRenamed("id", "before"), "before", "left_semi").select("id").distinct()
        stays = cut(stays.unionByName(new))
        open_ids = cut(open_ids.join(new, "id", "left_anti").join(goes, "id", "left_anti"))
        rivals = cut(rivals.join(open_ids, "id", "left_semi"))
    return stays


def distinct_titles(rows: DataFrame, group: str | None = None, order: tuple[str, ...] = ("job_order", "ord"), least_tokens: int = LEAST_TOKENS, percent: int = PERCENT) -> DataFrame:
    """``rows`` (url, title, ``order`` and any other columns) without later rows of a url, of a title key, or of a near-copy of a title, within each ``group`` or over all.

    Rows without url go; titles of fewer tokens than ``least_tokens`` are copies
    of equal keys only, and empty ones of none. Of rows with one place in the
    order the least by url and title counts as first. No group's rows come
    together in a task.
    """
    within = F.lit(0) if group is None else F.col(group)
    place = F.struct(*order, F.col("url"), F.col("title"))
    every = F.struct(*rows.columns)
    first = rows.filter("url is not null and url <> ''").groupBy(within.alias("group"), F.col("url").alias("__url")).agg(F.min_by(every, place).alias("row"))
    # The group's own columns may have these names, so rows stay packed.
    keyed = first.withColumn("key", title_key(F.col("row.title"))).withColumn("place", F.struct(*(F.col(f"row.{c}") for c in order), F.col("row.url"), F.col("row.title")))
    name = F.when(F.col("key") == "", F.col("__url")).otherwise(F.col("key"))
    one = keyed.groupBy("group", name.alias("name"), (F.col("key") == "").alias("bare")).agg(F.min_by(F.struct("row", "key", "place"), "place").alias("one"))
    items = cut(one.select("group", "one.*").withColumn("id", F.monotonically_increasing_id()).withColumn("tokens", F.array_distinct(F.split("key", " "))))
    long = items.filter(F.size("tokens") >= least_tokens).select("id", "group", "place", "tokens")
    entries = cut(exploded(rare_tokens(long, percent), ["id", "group", "place", "tokens"], F.col("prefix"), "token"))
    kept, left = [], entries.count()
    for _ in range(ROUNDS):
        if not left:
            break
        stays, entries = settled_by_earliest(entries, percent)
        kept.append(stays)
        before, left = left, entries.count()
        if (before - left) * SETTLED < before:
            break
    kept.append(settled_by_rivals(entries, percent))
    ids = kept[0]
    for more in kept[1:]:
        ids = ids.unionByName(more)
    short = items.filter(F.size("tokens") < least_tokens)
    return short.unionByName(items.join(ids, "id", "left_semi").select(short.columns)).select("row.*")
