"""Resharding by minimum-cost flow.

The new shards hold equal numbers of rows, at most one apart. A flow of least
cost from old shards to new ones says how many rows each old shard keeps and
gives away, a row's cost being its bytes: an old shard gives its smallest rows,
and one that may keep one row more saves the largest of those. Rows go in
blocks, a stretch of a giver's smallest rows to one taker. Only files of
shards that lose or get rows are written anew.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

OLD_SHARDS = 16
SHARDS = 24
ROW_BYTES = 8
#: Rows of all old shards together in one bin when the smallest are ranked; rows of a new shard that one task numbers and writes to one file, about.
BIN_ROWS, FILE_ROWS = 4096, 20_000


class Flow:
    """Successive shortest paths; here on graphs with a few arcs for each shard."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, source: int, sink: int) -> None:
        while True:
            far: list[float] = [float("inf")] * len(self.out)
            via = [-1] * len(self.out)
            far[source], queue, waiting = 0, deque([source]), {source}
            while queue:
                x = queue.popleft()
                waiting.discard(x)
                for e in self.out[x]:
                    if self.room[e] and far[x] + self.cost[e] < far[y := self.to[e]]:
                        far[y], via[y] = far[x] + self.cost[e], e
                        if y not in waiting:
                            waiting.add(y)
                            queue.append(y)
            if via[sink] < 0:
                return
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            most = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= most
                self.room[e ^ 1] += most


def forced(rows: dict[int, int], shards: int) -> dict[int, int]:
    """By old shard, how many rows it gives at most: all, or what is over the smaller of the new sizes."""
    least = sum(rows.values()) // shards
    return {s: n if s >= shards else max(0, n - least) for s, n in rows.items()}


def transfers(rows: dict[int, int], last: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """Blocks (old shard, first rank, end rank, new shard) of the rows that move, ranked from the smallest, in the fewest bytes.

    ``rows`` has each old shard's rows and ``last`` the size of the last of the
    rows that it would give at most (``forced``): the only ones that may stay,
    one for each shard, since new sizes are one apart. All other rows that
    ``forced`` counts move in any case.
    """
    total, most = sum(rows.values()), forced(rows, shards)
    names = sorted(rows)
    at = {s: 3 + i for i, s in enumerate(names)}
    new = [3 + len(names) + j for j in range(shards)]
    pool, spare = 2, 3 + len(names) + shards
    flow = Flow(spare + 1)
    leaves: dict[int, tuple[int, int]] = {}
    for s in names:
        flow.arc(0, at[s], rows[s])
        one = 1 if s < shards and most[s] else 0
        leaves[s] = flow.arc(at[s], pool, most[s] - one), flow.arc(at[s], pool, one, last.get(s, 0))
        if s < shards:
            flow.arc(at[s], new[s], rows[s])
    takes = [flow.arc(pool, j, total) for j in new]
    for j in new:
        flow.arc(j, 1, total // shards)
        flow.arc(j, spare, 1)
    flow.arc(spare, 1, total % shards)
    flow.run(0, 1)
    blocks, wanted = [], deque((j, n) for j, e in enumerate(takes) if (n := flow.used(e)))
    for s in names:
        given, left = 0, sum(flow.used(e) for e in leaves[s])
        while left:
            j, n = wanted.popleft()
            if n > left:
                wanted.appendleft((j, n - left))
            blocks.append((s, given, given + min(n, left), j))
            given, left = given + min(n, left), left - min(n, left)
    return blocks


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str, bins: int) -> DataFrame:
    """``rows`` with their rank from 0 within ``group``, in an order by hash, without a task for a whole group.

    Rows are dealt into ``bins`` by a hash of ``order``; a rank is the rows of
    the group in the bins before, and the place in the own bin. Rows come out
    dealt by group and bin.
    """
    rows = rows.withColumn("__bin", F.pmod(F.xxhash64(*order), F.lit(bins)))
    counts = rows.groupBy(*group, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(*group, "__bin").orderBy(*order)) - 1
    return rows.withColumn("__place", place).join(offsets, [*group, "__bin"]).withColumn(name, F.col("__before") + F.col("__place")).drop("__bin", "__place", "__before")


def old_shard(shards: int = OLD_SHARDS) -> Column:
    """The old layout of a table that has none: rows dealt by a hash of doc_id."""
    return F.pmod(F.xxhash64(F.lit("old"), "doc_id"), F.lit(shards)).cast("int")


def sized(rows: DataFrame, most: dict[int, int]) -> DataFrame:
    """__old, __gives, __edge and __below for each old shard in ``most`` (rows to give, by old shard): the size of the last of its smallest rows to give, and how many are smaller."""
    spark = rows.sparkSession
    gives = spark.createDataFrame([(s, n) for s, n in most.items() if n], "__old int, __gives long")
    by_size = Window.partitionBy("__old").orderBy("__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.groupBy("__old", "__size").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__upto", F.sum("__n").over(by_size))
        .join(F.broadcast(gives), "__old")  # a row for each old shard
        .filter("__upto >= __gives and __upto - __n < __gives")
        .select("__old", "__gives", F.col("__size").alias("__edge"), (F.col("__upto") - F.col("__n")).alias("__below"))
    )


def reshard(docs: DataFrame, shards: int = SHARDS, old: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, moved and old_shard, a row for each of ``docs``.

    The law is ``rows``: shards hold equal numbers of rows, at most one apart;
    slots go from 0 without gaps in each shard. Null and empty texts have no
    bytes, size 8 and the checksum 0; very long ones count whole. Repeated rows
    each get a slot. Which of several rows of one size goes follows a hash of
    the row. Columns of ``docs`` named in ``carry`` are put out too, but for
    those with the name of a result, which the result takes; columns may have
    any name that does not begin with two underscores. ``docs`` is read anew for
    them, so it has to give the same rows each time.
    """
    return resharded(docs, shards, old, carry)[0]


def resharded(docs: DataFrame, shards: int = SHARDS, old: Column | None = None, carry: tuple[str, ...] = ()) -> tuple[DataFrame, list[int]]:
    """What ``reshard`` gives, and the numbers of the shards, old and new, that rows leave or come to, as the flow's blocks name them."""
    text = F.coalesce("text", F.lit(""))
    results = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "moved", "old_shard")
    carry = tuple(c for c in carry if c not in results)
    held = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").alias("__id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("__size"), F.crc32(text).alias("__crc"),
        (old_shard() if old is None else old).cast("int").alias("__old"), held.alias("__held"),
    )
    slim = cut(rows.drop("__held"))
    if not carry:
        rows = slim.withColumn("__held", F.lit(None).cast("string"))
    # Rows of one number for each old shard: as many as there are shards, whatever the data.
    counts = {r[0]: r[1] for r in slim.groupBy("__old").agg(F.count(F.lit(1))).collect()}
    total = sum(counts.values())
    last = {r["__old"]: r["__edge"] for r in sized(slim, forced(counts, shards)).collect()} if total else {}
    blocks = transfers(counts, last, shards)
    gives: dict[int, int] = {}
    for s, _, end, _ in blocks:
        gives[s] = max(gives.get(s, 0), end)
    spark = docs.sparkSession
    # As many blocks as there are shards, old and new, at most; an edge for each old shard.
    plan = spark.createDataFrame(blocks, "__old int, __low long, __high long, __to int")
    edge = spark.createDataFrame(sized(slim, gives).collect(), "__old int, __gives long, __edge long, __below long")
    marked = rows.join(F.broadcast(edge), "__old", "left")
    small = marked.filter("__size <= __edge").withColumn("__tied", F.col("__size") == F.col("__edge"))
    order = ["__id", "__crc", "__size"]
    first = ranked(small, ["__old", "__tied"], order, "__rank", max(1, -(-total // BIN_ROWS))).withColumn("__rank", F.col("__rank") + F.when(F.col("__tied"), F.col("__below")).otherwise(0))
    p = plan.withColumnRenamed("__old", "__from")
    going = first.join(F.broadcast(p), F.expr("__old = __from and __rank >= __low and __rank < __high"), "left").withColumn("__shard", F.coalesce("__to", "__old"))
    kept = ["__id", "__size", "__crc", "__old", "__held"]
    placed = marked.filter("__edge is null or __size > __edge").select(*kept, F.col("__old").alias("__shard")).unionByName(going.select(*kept, "__shard"))
    touched = sorted({x for s, _, _, j in blocks if s != j for x in (s, j)})
    out = ranked(placed, ["__shard"], order, "__slot", max(1, -(-total // (shards * FILE_ROWS)))).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), (F.col("__shard") != F.col("__old")).alias("moved"), F.col("__old").alias("old_shard"), *(F.col("__held")[c].alias(c) for c in carry),
    )
    return out, touched


def rewrite(sharded: DataFrame, touched: list[int], path: str) -> None:
    """Writes the shards that lost or got rows, as ``path``/shard=N; files of others stay.

    Rows are written as ``reshard`` has dealt them, a file for FILE_ROWS rows of
    a shard or so, without another shuffle, and their plan runs once.
    """
    rows = sharded.filter(F.col("shard").isin(touched)).drop("moved", "old_shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def rewritten(sharded: DataFrame, touched: list[int], path: str, shards: int = SHARDS) -> DataFrame:
    """``sharded`` with the rows of rewritten shards read back from their new files; ``moved`` and ``old_shard`` are left out."""
    stayed = sharded.filter(~F.col("shard").isin(touched)).drop("moved", "old_shard")
    if not touched:
        return stayed
    rewrite(sharded, touched, path)
    files = sharded.sparkSession.read.schema(stayed.schema).parquet(path).filter(F.col("shard").isin(touched)).select(stayed.columns)
    return files if set(touched) >= set(range(shards)) else stayed.unionByName(files)
