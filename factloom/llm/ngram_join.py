"""N-gram Jaccard join over whole texts, exact.

Texts with equal shingle sets are one set, told by a 64-bit hash of its sum of
hashes. Sets meet in tiles: a tile holds the sets of one size band that share
a shingle, or a part of them if they are many. In a tile, bitmaps of hashed
shingles, two bits or more for each shingle of all but very long texts, bound
the overlap of a pair from above by counting bits that differ; pairs that the
bound leaves open are decided by intersecting sorted arrays.

Two sets that link share a shingle among the first quarter of each, in any
order of all shingles, so only those make tiles. The order puts shingles last
that many texts hold, as counted over all texts in a table of fixed width.
Shingles with the same sets make one tile. Copies would fill every tile of
theirs with links, so they are linked beforehand, by stars around a set's
smallest hashes, and once more by each class's best pair in a tile; what is
left between classes is compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WHITE, asked_for, cut, gram_hashes, hash_words, mix, slices, whole_groups, words_of
from factloom.llm.components import components

GRAM = 5
#: Sets link if their intersection has so many of 100 shingles of their union.
PERCENT = 75
#: Bits of a bitmap at most: a set goes to as many tiles as it has shingles, so what it brings must not grow with them.
MOST_BITS = 8192
#: Smallest hashes that make stars; width of the table of counts.
KEYS, WIDTH = 4, 1 << 16
#: Sets of a tile's side; a shingle with more has its size bands cut into blocks.
BLOCK = 1024
#: Two sizes whose ratio is 4/3 at most are in the same band or in neighbouring ones.
BAND = 1.34
#: A pair of sets: the keys of their texts, and their classes.
PAIR = "ka long, kb long, ca long, cb long"
#: Rows that a worker gathers before it compares them, and bytes of bitmaps that it compares at once.
GATHERED, COMPARED_BYTES = 4096, 8 << 20


def shingle_sets(texts: pa.Array, n: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; of the whole sequence if it is shorter, none without words."""
    offsets, codes, distinct = words_of(texts, lower=True)
    hashes = hash_words(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
    grams = gram_hashes(hashes, n)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(gram_hashes(hashes[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set, whatever the order."""
    one, two = int(mix(shingles).sum(dtype=np.uint64)), int(mix(~shingles).sum(dtype=np.uint64))
    return int(mix(np.array([(one * 0x9E3779B97F4A7C15 + two * 31 + len(shingles)) % 2**64], np.uint64))[0])


def bitmap(shingles: np.ndarray) -> bytes:
    """For each of some bits, whether an odd number of shingles falls on it; a power of two of bits, two or more for each shingle, MOST_BITS at most.

    Bits that differ are no more than shingles that differ. A bitmap of half as
    many bits is its two halves, one xor the other.
    """
    size = min(MOST_BITS, 1 << max(6, int(2 * len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Bitmaps:
    """Bitmaps of rows, to be compared in pairs whose sizes differ by a third at most."""

    def __init__(self, bits: list[bytes]):
        self.width = np.array([len(b) for b in bits], np.int64)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            own, wider = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            packed = [np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(len(own), -1)]
            if len(wider):
                halves = np.frombuffer(b"".join(bits[i] for i in wider), np.uint64).reshape(len(wider), 2, -1)
                packed.append(halves[:, 0] ^ halves[:, 1])
            place = np.zeros(len(bits), np.int64)
            place[np.r_[own, wider]] = np.arange(len(own) + len(wider))
            self.rows[w] = place, np.concatenate(packed)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits that differ between rows ``a`` and rows ``b``."""
        narrow = np.minimum(self.width[a], self.width[b])
        out = np.empty(len(a), np.int64)
        for w in np.unique(narrow).tolist():
            at = np.flatnonzero(narrow == w)
            place, packed = self.rows[w]
            step = max(1, COMPARED_BYTES // w)
            for i in range(0, len(at), step):
                one = at[i : i + step]
                out[one] = np.bitwise_count(packed[place[a[one]]] ^ packed[place[b[one]]]).sum(1, dtype=np.int64)
        return out


def sketched(rows: DataFrame, n: int) -> DataFrame:
    """A row for each of ``rows`` (doc_id, key, text): doc_id, key, n, sid, bits, keys; and rows (bucket, times): how many of a task's texts hold shingles of a bucket."""

    def run(batches):
        times = np.zeros(WIDTH, np.int64)
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), n)
            for s in sets:
                np.add.at(times, (s >> np.uint64(48)).astype(np.int64), 1)
            count = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(np.array([set_id(s) for s in sets], np.uint64).view(np.int64)),
                    pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([s[:KEYS].view(np.int64).tolist() for s in sets], pa.list_(pa.int64())),
                    pa.nulls(count, pa.int32()), pa.nulls(count, pa.int64()),
                ],
                names=names,
            )
        hit = np.flatnonzero(times)
        empty = [pa.nulls(len(hit), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(hit.astype(np.int32)), pa.array(times[hit])], names=names)

    names = ["doc_id", "key", "n", "sid", "bits", "keys", "bucket", "times"]
    return rows.mapInArrow(run, "doc_id long, key long, n int, sid long, bits binary, keys array<long>, bucket int, times long")


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def may_link(total: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``total`` shingles together, with bitmaps that differ in ``differ`` bits, can link.

    Sets link if the overlap is percent / (100 + percent) of the sum of sizes
    at least; the overlap is half of that sum less the bits that differ at most.
    """
    return (100 - percent) * total >= (100 + percent) * differ


def bounded(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of ``pairs`` (a, b) of sets those that sizes and bitmaps leave open: ka, kb (keys of their texts), ca, cb (classes)."""

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                k = batch.num_rows
                differ = Bitmaps(batch.column("bits_a").to_pylist() + batch.column("bits_b").to_pylist()).differ(np.arange(k), np.arange(k) + k)
                total = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
                yield batch.select(["ka", "kb", "ca", "cb"]).filter(pa.array(may_link(total, differ, percent)))

    one, two = (sets.select(F.col("sid").alias(x), F.col("key").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("class").alias(f"c{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    near = pairs.join(one, "a").join(two, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return near.mapInArrow(keep, PAIR)


def verified(pairs: DataFrame, rows: DataFrame, n: int, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes from the ``pairs`` (ka, kb, ca, cb) that link, by exact intersection of their texts' sorted shingles."""

    def arrays(batches):
        seen: set[int] = set()  # copies of a text give its array once
        for batch in slices(batches):
            keys = batch.column("key").to_pylist()
            new = [k not in seen and not seen.add(k) for k in keys]
            batch = batch.filter(pa.array(new, pa.bool_()))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), n)], pa.binary())], names=["key", "shingles"])

    def run(batches):
        for batch in slices(batches, "one"):
            first = batch.column("two").dictionary_encode()
            left = [np.frombuffer(x, np.uint64) for x in first.dictionary.to_pylist()]
            keep = [linked(left[i], np.frombuffer(x, np.uint64), percent) for i, x in zip(first.indices.to_pylist(), batch.column("one").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # No join with the keys themselves: Spark would move it below the filter, and send all texts.
    texts = asked_for(rows.select("key", "text"), pairs.select(F.explode(F.array("ka", "kb")).alias("key")))
    found = texts.mapInArrow(arrays, "key long, shingles binary").dropDuplicates(["key"])
    one, two = found.select(F.col("key").alias("ka"), F.col("shingles").alias("one")), found.select(F.col("key").alias("kb"), F.col("shingles").alias("two"))
    return pairs.join(one, "ka").join(two, "kb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "one", "two").mapInArrow(run, "a long, b long")


def stars(sets: DataFrame) -> DataFrame:
    """Candidate pairs of each set with the smallest and the largest id that shares one of its smallest hashes."""
    entries = cut(sets.select("sid", F.explode("keys").alias("key")))
    centres = entries.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low <> high").select("key", F.explode(F.array("low", "high")).alias("c"))
    return entries.join(centres, "key").filter("sid <> c").select(F.least("sid", "c").alias("a"), F.greatest("sid", "c").alias("b")).distinct()


def prefixes(rows: DataFrame, times: np.ndarray, n: int) -> DataFrame:
    """(shingle, sid) for the first quarter of each set's shingles, the rarest buckets first; a task gives each set once."""

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            kept, ids, counts = [], [], []
            for s in shingle_sets(batch.column("text"), n):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                p = len(s) - -(-3 * len(s) // 4) + 1
                rank = times[(s >> np.uint64(48)).astype(np.int64)]
                kept.append(s[np.argsort(rank, kind="stable")[:p]])
                ids.append(sid)
                counts.append(p)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept).view(np.int64)), pa.array(np.repeat(np.array(ids, np.uint64), counts).view(np.int64))], names=["shingle", "sid"])

    return rows.select("text").mapInArrow(run, "shingle long, sid long")


def shared(entries: DataFrame) -> DataFrame:
    """(tile, sid, of): the sets that share a shingle, two or more, and how many they are; shingles with the same sets make one tile.

    Reads each partition, sorted by shingle, as a stream. The sets of a shingle
    with very many come as they are, with the shingle for a tile.
    """

    def run(batches):
        names = ["tile", "sid", "of"]
        seen = np.empty(0, np.uint64)
        for piece, (h, s) in whole_groups(batches, ["shingle", "sid"], 1 << 17):
            if piece:
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(s), pa.array(np.full(len(h), 1 << 30))], names=names)
                continue
            new = np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])]  # a set comes from many tasks
            h, s = h[new], s[new]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            sizes = np.diff(np.r_[starts, len(h)])
            tiles = mix(np.add.reduceat(mix(s.view(np.uint64)), starts) + sizes.astype(np.uint64))
            tiles, first = np.unique(np.where(sizes > 1, tiles, np.uint64(0)), return_index=True)
            fresh = (sizes[first] > 1) & ~np.isin(tiles, seen)
            tiles, first = tiles[fresh], first[fresh]
            seen = np.concatenate([seen, tiles])
            count = sizes[first]
            at = np.repeat(starts[first] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(tiles.view(np.int64), count)), pa.array(s[at]), pa.array(np.repeat(count, count))], names=names)

    dealt = entries.repartition("shingle").sortWithinPartitions("shingle", "sid")
    return dealt.mapInArrow(run, "tile long, sid long, of long").dropDuplicates(["tile", "sid"])


def blocked(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` of large tiles, dealt to tiles by size band and pairs of blocks, with own and block."""
    band = F.floor(F.log("n") / F.log(F.lit(BAND)))
    banded = (
        members.join(sets.select("sid", "n"), "sid").withColumn("band", band)
        .select("tile", "sid", "band", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("held")).withColumn("own", F.col("held") == F.col("band"))
    )
    parts = banded.groupBy("tile", "held").agg(F.count(F.lit(1)).alias("part"), F.max("own").alias("any")).filter("any")
    blocks = F.ceil(F.col("part") / BLOCK)
    return (
        banded.join(parts, ["tile", "held"]).withColumn("block", F.pmod(F.xxhash64("sid"), blocks))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select(F.xxhash64("tile", "held", F.least("block", "with"), F.greatest("block", "with")).alias("tile"), "sid", "own", "block")
    )


def tiled(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(tile, sid, own, block) from (tile, sid, of): tiles of BLOCK sets a side at most."""
    few = members.filter(F.col("of") <= BLOCK).select("tile", "sid", F.lit(True).alias("own"), F.lit(0).cast("long").alias("block"))
    many = members.filter(F.col("of") > BLOCK)
    return few if many.isEmpty() else few.unionByName(blocked(many, sets))


def open_pairs(tiles: DataFrame, classes: DataFrame, best: bool, percent: int = PERCENT) -> DataFrame:
    """Pairs (ka, kb, ca, cb) across classes that sizes and bitmaps leave open in a tile; with ``best`` the closest pair of each class only."""

    def run(batches):
        names = ["tile", "n", "key", "class", "own", "block", "bits"]
        for _, columns in whole_groups(batches, names, GATHERED):
            # Tiles of one class are done with.
            starts = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
            mixed = np.minimum.reduceat(columns[3], starts) != np.maximum.reduceat(columns[3], starts)
            kept = np.repeat(mixed, np.diff(np.r_[starts, len(columns[0])]))
            if not kept.any():
                continue
            t, n, k, c, own, block, bits = (x[kept] for x in columns)
            n = n.astype(np.int64)
            number = np.cumsum(np.r_[0, t[1:] != t[:-1]])
            starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            two_blocks = np.minimum.reduceat(block, starts) != np.maximum.reduceat(block, starts)
            place = number * (4 << 31) + n  # tiles and sizes rise
            counts = np.searchsorted(place, number * (4 << 31) + 100 * n // percent, "right") - np.arange(len(n)) - 1
            maps = Bitmaps(bits.tolist())
            found = []
            upto, first = np.cumsum(counts), 0
            while first < len(n):  # about a million pairs at once
                before = upto[first] - counts[first]
                last = max(first + 1, int(np.searchsorted(upto, before + (1 << 20), "right")))
                one = np.repeat(np.arange(first, last), counts[first:last])
                two = one + 1 + np.arange(len(one)) - np.repeat(upto[first:last] - counts[first:last] - before, counts[first:last])
                fit = (c[one] != c[two]) & (own[one] | own[two]) & (~two_blocks[number[one]] | (block[one] != block[two]))
                one, two = one[fit], two[fit]
                differ = maps.differ(one, two)
                left = may_link(n[one] + n[two], differ, percent)
                found.append(np.c_[one[left], two[left], differ[left] * 1000 // (n[one[left]] + n[two[left]])])
                first = last
            found = np.concatenate(found)
            if best and len(found):
                ends, far = np.r_[found[:, 0], found[:, 1]], np.r_[found[:, 2], found[:, 2]]
                order = np.lexsort((far, c[ends], number[ends]))
                by = np.c_[number[ends], c[ends]][order]
                top = np.r_[True, (by[1:] != by[:-1]).any(1)]
                found = found[np.unique(order[top] % len(found))]
            one, two = found[:, 0], found[:, 1]
            turned = k[one] > k[two]
            one, two = np.where(turned, two, one), np.where(turned, one, two)
            pairs = np.unique(np.c_[k[one], k[two], c[one], c[two]], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(x.copy()) for x in pairs.T], names=["ka", "kb", "ca", "cb"])

    dealt = tiles.join(classes.select("sid", "key", "n", "class", "bits"), "sid").repartition("tile").sortWithinPartitions("tile", "n")
    return dealt.mapInArrow(run, PAIR).distinct()


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` after ``links`` (a, b) have joined some of them."""
    found = components(links)
    rest = [c for c in classes.columns if c != "class"]
    return cut(classes.join(found, F.col("class") == F.col("node"), "left").select(*rest, F.coalesce("component", "class").alias("class")))


def ngram_join(docs: DataFrame, n: int = GRAM) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links), a row for each of ``docs``.

    Null and empty texts, and texts of white space, have no shingles and link
    with nothing. Very long texts are taken whole, each in a slice of its own.
    Repeated rows are put out each. Rows with equal doc_id count as one
    document: what links with one links with all. A row without doc_id has its
    size and no component, and links nothing. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("text"))
    first = cut(sketched(rows.select("doc_id", "key", "text"), n))
    times = np.zeros(WIDTH, np.int64)
    for bucket, total in first.filter("bucket is not null").groupBy("bucket").agg(F.sum("times")).collect():  # WIDTH rows at most
        times[bucket] = total
    every = first.filter("bucket is null").select("doc_id", "n", "sid", "key", "bits", "keys")
    filled = every.filter("n > 0 and doc_id is not null")
    sets = cut(
        filled.groupBy("sid").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys"), F.min("doc_id").alias("least"))
        .withColumn("class", F.col("sid"))
    )
    texts = rows.filter("doc_id is not null")

    # Different texts of one id are one document.
    ids = filled.groupBy("doc_id").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low <> high")
    same = filled.join(ids, "doc_id").select(F.col("low").alias("a"), F.col("sid").alias("b")).filter("a <> b")
    classes = merged(sets.drop("keys"), verified(cut(bounded(stars(sets), sets)), texts, n).unionByName(same))
    members = cut(shared(prefixes(texts, times, n)))
    tiles = tiled(members, sets)
    for best in (True, False):
        classes = merged(classes, verified(cut(open_pairs(tiles, classes, best)), texts, n))

    # A component's least doc_id is that of one of its sets.
    named = classes.join(classes.groupBy("class").agg(F.min("least").alias("component_id")), "class").select("sid", "component_id")
    return every.select("doc_id", "n", "sid").join(named, "sid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id")
    )


def one_of_each(docs: DataFrame, n: int = GRAM) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (null last), and all columns.

    A document is an id with its text, told by a 64-bit hash of both: different
    texts under one id are judged each, and so are texts without id. Rows with
    neither id nor words stay. Which row stays does not hang on partitions;
    rows equal in id and text differ in other columns at most, and of them any
    one stays. Columns may have any name that does not begin with two underscores.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = ngram_join(keyed.select(F.col("__key").alias("doc_id"), "text"), n).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key")
    keep = keyed.select("doc_id", "__key").join(found, "__key").groupBy("component_id").agg(F.min(order)["__key"].alias("__key"))
    keep = cut(keep.select("__key"))
    nothing = F.col("doc_id").isNull() & (F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE))) == 0)
    rows = keyed.filter(~nothing)
    # Only rows that may go are sent: those of keys that aren't kept, and those of keys with several rows.
    doubtful = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).join(keep.withColumn("stays", F.lit(True)), "__key", "left").filter("n > 1 or stays is null")
    marked = asked_for(rows, doubtful.select("__key"), "__asked", "__key")
    kept = marked.filter("__asked").join(keep, "__key", "left_semi").dropDuplicates(["__key"])
    return kept.unionByName(marked.filter("not __asked").select(kept.columns)).drop("__key", "__asked").unionByName(docs.filter(nothing))
