"""Row pattern matching: ``A (D|U)* P D*`` over each client's rows in time.

All rows are sorted into blocks by client, time and id, so a client with many
rows takes many blocks. A row that can follow no other one begins a new run, and
no match reaches over that, so runs are matched each by itself: a block's task
matches those that lie in it; the few rows at its ends meet their neighbours in
a second step; runs of more than WHOLE rows, which may lie in many blocks, are
matched by joins that double their reach, so that no task gets such a run whole.

Within a run a row asks for its goal, the row that P takes. A scan from the end
keeps the goals that no later one exceeds, a stack that only rises, as
suffix-maximum records; the last goal that is high enough, which greedy
repetition finds, is a binary search on them. For reluctant repetition the scan
keeps the stack of next greater or equal goals.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

#: Rows of a run that one task takes; rows that it gathers before it matches them.
WHOLE = 1 << 16
#: What is known of a row: it has cents; its kind is view; its kind may be D or U; it is D or U, and D, after the row before; P may follow that; it begins a run; it is its block's first, or last.
HAS, VIEW, STEADY, STEP, DOWN, GOAL, START, FIRST, LAST = (1 << k for k in range(9))
ROW = "client_id long, ts long, click_id long, cents long, flags int"
FOUND = f"block int, part int, pos long, {ROW}, rank long, first_id long, last_id long, n_rows long, sum_cents long, labels string"
MATCH = "block int, part int, client_id long, rank long, first_id long, last_id long, n_rows long, sum_cents long, labels string"
MATCHED = [x.split()[0] for x in MATCH.split(", ")]
ORDER = ["client_id", "ts", "click_id", "cents", "flags"]


def clicks_in_order(clicks: DataFrame) -> DataFrame:
    """The distinct rows as ROW, sorted into blocks: as many as the session's shuffle partitions."""
    value = F.col("value").cast("double")
    cents = F.when(F.abs(value) < 9e16, F.floor(100 * value + 0.5)).cast("long")
    bit = lambda c, b: F.when(c, b).otherwise(0)
    flags = bit(F.col("cents").isNotNull(), HAS) + bit(F.col("kind") == "view", VIEW) + bit(F.col("kind") != "error", STEADY)
    rows = (
        clicks.filter("client_id is not null and ts is not null").distinct().withColumn("cents", cents)
        .select(F.col("client_id").cast("long").alias("client_id"), "ts", F.col("click_id").cast("long").alias("click_id"), "cents", flags.cast("int").alias("flags"))
    )
    parts = int(clicks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)


def compared(client, ts, cents, flags, gap: int) -> np.ndarray:
    """``flags`` with what a row is after the one before it, for all rows but the first."""
    has = flags & HAS != 0
    near = (client[1:] == client[:-1]) & (ts[1:] - ts[:-1] <= gap) & has[1:] & has[:-1]
    step = near & (flags[1:] & STEADY != 0) & (cents[1:] != cents[:-1])
    goal = near & (flags[1:] & VIEW != 0)
    out = flags.copy()
    out[1:] |= np.where(step, STEP, 0) | np.where(step & (cents[1:] < cents[:-1]), DOWN, 0) | np.where(goal, GOAL, 0) | np.where(step | goal, 0, START)
    return out


def last_goals(cents: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """For each row the last goal of its cents or more that steps lead to, greedily; -1 without any."""
    n = len(cents)
    segment = np.cumsum(flags & STEP == 0)  # what steps cannot pass
    rank = np.unique(cents, return_inverse=True)[1]
    goals = np.flatnonzero(flags & GOAL)[::-1]
    key = (segment[-1] - segment[goals - 1]) * n + rank[goals]
    record = np.r_[True, key[1:] > np.maximum.accumulate(key)[:-1]] if len(key) else np.zeros(0, bool)
    key, goals = np.r_[key[record], np.iinfo(np.int64).max], np.r_[goals[record], -1]
    asked = (segment[-1] - segment) * n + rank
    at = np.searchsorted(key, asked)
    fit = (key[at] // n == asked // n) & (goals[at] > np.arange(n)) & (flags & HAS != 0)
    return np.where(fit, goals[at], -1)


def next_goals(cents: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """For each row the next goal of its cents or more that steps lead to, reluctantly; -1 without any."""
    out = np.full(len(cents), -1)
    depths: list[int] = []  # of the stack's goals, minus their cents: they rise towards the nearest
    stack: list[int] = []
    for i in range(len(cents) - 1, -1, -1):
        c, f = int(cents[i]), int(flags[i])
        if f & HAS and (found := bisect_right(depths, -c)):
            out[i] = stack[found - 1]
        if not f & STEP:
            depths, stack = [], []
        if f & GOAL:
            while depths and depths[-1] >= -c:
                depths.pop()
                stack.pop()
            depths.append(-c)
            stack.append(i)
    return out


def solve(client, ids, cents, flags, greedy: bool) -> dict[str, list]:
    """The matches of whole runs, by place of their first row: at, client, first, last, n, sum, labels."""
    goals = (last_goals if greedy else next_goals)(cents, flags)
    others = np.r_[np.flatnonzero(flags & DOWN == 0), len(cents)]
    ends = others[np.searchsorted(others, np.arange(len(cents)), "right")] - 1
    ahead = np.minimum.accumulate(np.where(goals >= 0, np.arange(len(cents)), len(cents))[::-1])[::-1].tolist()
    goal, end = goals.tolist(), ends.tolist()
    letters = np.where(flags & DOWN, ord("D"), ord("U")).astype(np.uint8).tobytes()
    at, stop, labels = [], [], []
    i = ahead[0]
    while i < len(goal):
        j = goal[i]
        k = end[j]
        at.append(i)
        stop.append(k)
        labels.append((b"A" + letters[i + 1 : j] + b"P" + b"D" * (k - j)).decode())
        i = ahead[k]
    at, stop, total = np.array(at, np.int64), np.array(stop, np.int64), np.r_[0, np.cumsum(cents)]
    return {"at": at, "client": client[at], "first": ids[at], "last": ids[stop], "n": stop - at + 1, "sum": total[stop + 1] - total[at], "labels": labels}


def places(values: np.ndarray) -> np.ndarray:
    """1, 2, ... within each stretch of equal values."""
    new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)
    at = np.arange(len(values))
    return at - np.maximum.accumulate(np.where(new, at, 0)) + 1


def blocks(rows: DataFrame, gap: int, greedy: bool) -> DataFrame:
    """FOUND: matches of the runs that lie in a block, ranked by client within a part of it; rows of the other runs, by part and place in it."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    kinds = [types[x.split()[1]] for x in FOUND.split(", ")]

    def batch_of(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

    def run(batches):
        block, part, pos = TaskContext.get().partitionId(), 0, 0
        held, gathered, waiting, is_open = None, [], 0, True  # the block's first row may go on with a run

        def edge(columns):
            nonlocal pos
            n = len(columns[0])
            pos += n
            return batch_of(n, block=np.full(n, block), part=np.full(n, part), pos=np.arange(pos - n, pos), **dict(zip(ORDER, columns, strict=True)))

        def step(new):
            nonlocal held, part, pos, is_open
            if held is None:
                rows = list(new)
                rows[4][0] |= FIRST
                known = 0
            else:
                rows = [np.concatenate(x) for x in zip(held, new, strict=True)]
                known = len(held[0])
            whole = compared(rows[0], rows[1], rows[3], rows[4], gap)
            rows[4][max(known, 1) :] = whole[max(known, 1) :]
            starts = np.flatnonzero(rows[4] & START)
            if is_open:
                first = int(starts[0]) if len(starts) else len(rows[0]) - 1
                if first:
                    yield edge([x[:first] for x in rows])
                rows = [x[first:] for x in rows]
                if not len(starts):
                    held = rows
                    return
                starts, is_open, pos = starts - first, False, 0
                part += 1
            last = int(starts[-1])
            if last:
                found = solve(rows[0][:last], rows[2][:last], rows[3][:last], rows[4][:last], greedy)
                n = len(found["at"])
                if n:
                    yield batch_of(n, block=np.full(n, block), part=np.full(n, part), client_id=found["client"], rank=places(found["client"]), first_id=found["first"], last_id=found["last"], n_rows=found["n"], sum_cents=found["sum"], labels=found["labels"])
                part += 1
            held = [x[last:] for x in rows]
            if len(held[0]) >= WHOLE:
                is_open = True
                yield edge([x[:-1] for x in held])
                held = [x[-1:] for x in held]

        for batch in batches:
            if batch.num_rows:
                gathered.append([batch.column("client_id").to_numpy(), batch.column("ts").cast(pa.timestamp("us", batch.column("ts").type.tz)).cast(pa.int64()).to_numpy(), batch.column("click_id").fill_null(-1).to_numpy(), batch.column("cents").fill_null(0).to_numpy(), batch.column("flags").to_numpy()])
                waiting += batch.num_rows
                if waiting >= WHOLE:
                    yield from step([np.concatenate(x) for x in zip(*gathered, strict=True)])
                    gathered, waiting = [], 0
        if waiting:
            yield from step([np.concatenate(x) for x in zip(*gathered, strict=True)])
        if held is not None:
            held[4] = held[4].copy()
            held[4][-1] |= LAST
            yield edge(held)

    return rows.mapInArrow(run, FOUND)


def has(flag: int, column: str = "flags") -> Column:
    return F.col(column).bitwiseAND(flag) != 0


def linked_runs(edges: DataFrame, gap: int) -> DataFrame:
    """``edges`` with run (its first piece), p (place in it) and size (its rows), a block's first row compared with the last one of the block before.

    What is joined here has some rows for each block, and pieces find their
    run's first one by pointers that double their reach.
    """
    lasts = edges.filter(has(LAST)).select((F.col("block") + 1).alias("block"), F.col("part").alias("last_part"), F.col("client_id").alias("c"), F.col("ts").alias("t"), F.col("cents").alias("m"), F.col("flags").alias("f"))
    firsts = edges.filter(has(FIRST)).select("block", "client_id", "ts", "cents", "flags").join(lasts, "block", "left")
    near = (F.col("c") == F.col("client_id")) & (F.col("ts") - F.col("t") <= gap) & has(HAS) & has(HAS, "f")
    step, goal = near & has(STEADY) & (F.col("cents") != F.col("m")), near & has(VIEW)
    more = F.when(step, STEP).otherwise(0) + F.when(step & (F.col("cents") < F.col("m")), DOWN).otherwise(0) + F.when(goal, GOAL).otherwise(0) + F.when(F.coalesce(step | goal, F.lit(False)), 0).otherwise(START)
    key = lambda block, part: F.col(block) * F.lit(1 << 32) + F.col(part)
    first = cut(firsts.select("block", F.col("last_part"), more.cast("int").alias("more")))
    pieces = edges.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n"), F.bit_or("flags").alias("flags")).withColumn("piece", key("block", "part"))
    before = first.filter(~has(START, "more")).select("block", ((F.col("block") - 1) * F.lit(1 << 32) + F.col("last_part")).alias("before"))
    one = pieces.join(before, "block", "left").select("piece", "n", F.when(has(FIRST), F.col("before")).alias("before"))
    sizes = one.select(F.col("piece").alias("before"), F.col("n").alias("offset"))
    to = cut(one.join(sizes, "before", "left").select("piece", "n", F.coalesce("before", "piece").alias("to"), F.coalesce("offset", F.lit(0)).alias("offset")))
    while True:
        x, y = to.alias("x"), to.select(F.col("piece").alias("q"), F.col("to").alias("further"), F.col("offset").alias("more")).alias("y")
        to = cut(x.join(y, F.expr("x.to = y.q")).select("x.piece", "x.n", F.col("further").alias("to"), (F.col("offset") + F.col("more")).alias("offset"), (F.col("to") != F.col("further")).alias("moved")))
        if to.filter("moved").isEmpty():
            break
    total = to.groupBy("to").agg(F.sum("n").alias("size"))
    named = to.join(total, "to").select("piece", F.col("to").alias("run"), "offset", "size")
    flags = F.when(has(FIRST), F.col("flags") + F.col("more")).otherwise(F.col("flags"))
    found = edges.join(first.select("block", "more"), "block").withColumn("piece", key("block", "part")).join(named, "piece")
    return found.select("run", (F.col("offset") + F.col("pos")).alias("p"), "size", "block", "part", *ORDER[:4], flags.cast("int").alias("flags"))


def whole_runs(rows: DataFrame, greedy: bool) -> DataFrame:
    """MATCH of runs that lie in several blocks, each in one group of WHOLE rows at most."""

    def run(table):
        table = table.sort_by("p")
        column = lambda c: table.column(c).to_numpy()
        found = solve(column("client_id"), column("click_id"), column("cents"), column("flags"), greedy)
        block, part = column("block")[found["at"]], column("part")[found["at"]]
        rank = places(block.astype(np.int64) * (1 << 32) + part)
        return pa.table([block, part, found["client"], rank, found["first"], found["last"], found["n"], found["sum"], pa.array(found["labels"], pa.string())], names=MATCHED)

    return rows.groupBy("run").applyInArrow(run, MATCH)


def long_goals(rows: DataFrame, greedy: bool) -> DataFrame:
    """(run, p, goal) for rows with a goal: tables of the highest goal within 1, 2, 4, ... rows, and a descent through them."""
    node = cut(rows.select("run", F.col("p").alias("x"), F.when(has(GOAL), F.col("cents")).alias("v"), F.when(has(STEP) & (F.col("p") + 1 < F.col("size")), F.col("p") + 1).alias("y")))
    levels, last = [], node
    while not last.filter("y is not null").isEmpty():
        b = last.select("run", F.col("x").alias("y"), F.col("v").alias("w"), F.col("y").alias("z"))
        levels.append(cut(last.filter("y is not null").join(b, ["run", "y"])))
        rest = last.filter("y is null").select("run", "x", "v", "y")
        last = cut(levels[-1].select("run", "x", F.greatest("v", "w").alias("v"), F.col("z").alias("y")).unionByName(rest))
    at = rows.filter(has(HAS) & (F.col("p") + 1 < F.col("size"))).select("run", "p", F.col("cents").alias("c"), (F.col("p") + 1).alias("x"))
    for level in reversed(levels):
        on = F.col("w") >= F.col("c") if greedy else F.coalesce(F.col("v") < F.col("c"), F.lit(True))
        at = cut(at.join(level, ["run", "x"], "left").select("run", "p", "c", F.when(F.col("y").isNotNull() & on, F.col("y")).otherwise(F.col("x")).alias("x")))
    return at.join(node, ["run", "x"]).filter("v >= c").select("run", "p", F.col("x").alias("goal"))


def long_runs(rows: DataFrame, greedy: bool) -> DataFrame:
    """MATCH of runs of any length, by joins on run and place only.

    Goals, ends of falling rows and the chain of first rows are each found in
    as many joins as the run's length has binary digits; letters are gathered by
    stretches of WHOLE rows.
    """
    rows = cut(rows)
    goals = long_goals(rows, greedy)
    falls = rows.filter(has(DOWN)).select("run", (F.col("p") - 1).alias("p"), F.col("p").alias("to"))
    end = cut(rows.select("run", "p").join(falls, ["run", "p"], "left").select("run", "p", F.coalesce("to", "p").alias("to")))
    while True:
        further = end.select("run", F.col("p").alias("to"), F.col("to").alias("far"))
        end = cut(end.join(further, ["run", "to"]).select("run", "p", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        if end.filter("moved").isEmpty():
            break
    ends = end.select("run", F.col("p").alias("goal"), F.col("to").alias("end"))
    matches = cut(goals.join(ends, ["run", "goal"]))
    hop = rows.select("run", "p", "size").join(matches.select("run", "p", "end"), ["run", "p"], "left").select("run", "p", F.coalesce("end", F.col("p") + 1).alias("to"), "size")
    hop = cut(hop.filter("to < size").select("run", "p", "to"))
    reached = cut(rows.filter("p = 0").select("run", "p"))
    while not hop.isEmpty():
        reached = cut(reached.unionByName(reached.join(hop, ["run", "p"]).select("run", F.col("to").alias("p"))).distinct())
        further = hop.select("run", F.col("p").alias("to"), F.col("to").alias("far"))
        hop = cut(hop.join(further, ["run", "to"]).select("run", "p", F.col("far").alias("to")))
    chosen = matches.join(reached, ["run", "p"], "left_semi").select("run", F.col("p").alias("i"), F.col("goal").alias("j"), F.col("end").alias("k"))
    stretch = lambda c: F.floor(F.col(c) / WHOLE)
    pieces = cut(chosen.withColumn("stretch", F.explode(F.sequence(stretch("i"), stretch("k")))))

    def letters(left, right):
        left = left.sort_by("p")
        p, cents, flags, ids = (left.column(c).to_numpy() for c in ("p", "cents", "flags", "click_id"))
        text = np.where(flags & DOWN, ord("D"), ord("U")).astype(np.uint8)
        total, out = np.r_[0, np.cumsum(cents)], []
        for m in right.to_pylist():
            a, b = max(0, m["i"] - int(p[0])), min(len(p), m["k"] + 1 - int(p[0]))
            own = text[a:b].copy()
            for at, letter in ((m["i"], "A"), (m["j"], "P")):
                if 0 <= at - p[a] < b - a:
                    own[at - p[a]] = ord(letter)
            out.append({"run": m["run"], "i": m["i"], "stretch": m["stretch"], "n": b - a, "sum": int(total[b] - total[a]), "first": int(ids[a]), "last": int(ids[b - 1]), "text": own.tobytes().decode()})
        return pa.Table.from_pylist(out, schema=pa.schema([(c, pa.string() if c == "text" else pa.int64()) for c in ("run", "i", "stretch", "n", "sum", "first", "last", "text")]))

    own = rows.select("run", stretch("p").alias("stretch"), "p", "cents", "flags", "click_id")
    read = own.groupBy("run", "stretch").cogroup(pieces.groupBy("run", "stretch")).applyInArrow(letters, "run long, i long, stretch long, n long, sum long, first long, last long, text string")
    whole = read.groupBy("run", "i").agg(
        F.min_by("first", "stretch").alias("first_id"), F.max_by("last", "stretch").alias("last_id"), F.sum("n").alias("n_rows"), F.sum("sum").alias("sum_cents"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "text"))), lambda x: x["text"]), "").alias("labels"),
    )
    named = whole.join(rows.select("run", F.col("p").alias("i"), "block", "part", "client_id"), ["run", "i"])
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("run", "block", "part").orderBy("i")).cast("long")).select(*MATCHED)


def row_patterns(clicks: DataFrame, gap_minutes: int = 15, greedy: bool = True) -> DataFrame:
    """client_id, match_no, first_id, last_id, n_rows, sum_cents and labels of every match in ``clicks`` (click_id, ts, client_id, kind, value).

    Rows are distinct over all their columns, others than these included, which
    are not read beyond that. Rows without client_id or ts are left out; a null
    click_id comes first among equal times and is put out as -1; rows that tie in
    time and id go by cents. A null or non-finite value fits no letter, a null
    kind neither D nor U nor P. ``greedy`` tells whether (D|U)* takes as many
    rows as it can or as few. A search starts at the first row, one row on
    without a match, and at a match's last row after it. An empty table gives no
    rows. Labels of a match are one string, however long.
    """
    gap = gap_minutes * 60_000_000
    found = cut(blocks(clicks_in_order(clicks), gap, greedy))
    matches = found.filter("labels is not null").select(*MATCHED)
    runs = cut(linked_runs(found.filter("labels is null").select("block", "part", "pos", *ORDER), gap).filter("size > 1"))
    matches = matches.unionByName(whole_runs(runs.filter(F.col("size") <= WHOLE), greedy))
    long = runs.filter(F.col("size") > WHOLE)
    if not long.isEmpty():
        matches = matches.unionByName(long_runs(long, greedy))
    matches = cut(matches)
    # A client has one part, or some for each of its blocks.
    counts = matches.groupBy("client_id", "block", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("client_id").orderBy("block", "part")
    offsets = counts.withColumn("offset", F.sum("n").over(before) - F.col("n")).filter("offset > 0").drop("n")
    numbered = matches.join(offsets, ["client_id", "block", "part"], "left")
    return numbered.select("client_id", (F.coalesce("offset", F.lit(0)) + F.col("rank")).alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels")


def digest(matches: DataFrame) -> DataFrame:
    return matches.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", F.sha2(F.col("labels").cast("binary"), 256).alias("labels_sha256"))
