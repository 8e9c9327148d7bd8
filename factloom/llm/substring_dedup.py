"""Removal of word sequences that occur elsewhere, by compressed FM-indexes.

Two equal windows pick the same anchor, the run of ANCHOR words with the least
hash in them, so what can match meets at an anchor. Around each anchor that
occurs twice or more lies a segment of the windows that picked it. Segments of
one anchor and hash, 128 bits together, are a class; one occurrence of each class, and a second one where there
is one, are dealt by anchor into shards. A shard is indexed once (suffix array,
Burrows-Wheeler transform, wavelet matrix of packed digits with sampled ranks and
popcounts), and a segment of each class is streamed against the index: backward
search gives matching statistics, and every stretch of at least WINDOW words with
two occurrences or more is reported as an interval, for all members of the class.
So hashes only rule out; that a stretch repeats is told by its words.

An anchor with very many classes is dealt by the words beside it as well: a
window has so many words before or after its anchor, so two equal ones meet with
those of one side.

An anchor's first word is a symbol of its own in the index, so an occurrence is
found in the segment of its own anchor only and none is counted twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import asked_for, cut, gram_hashes, hash_words, mix, release, slices, whole_groups, words_of

WINDOW = 35
ANCHOR = 8
#: Words of the runs by which hopeless ends of segments are cut off; a power of two.
PROBE = 8
#: Segments in a shard, about.
SHARD_SEGMENTS = 8192
#: Anchors that a worker gathers before it looks for repeated ones.
GATHERED = 1 << 17
#: Bits for a segment's length and for its anchor's place in it.
SPOT_BITS = 16


def sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each run of ``size``, by doubling."""
    out, width = values, 1
    while 2 * width <= size:
        out, width = best(out[: len(out) - width], out[width:]), 2 * width
    rest = size - width
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(offsets: np.ndarray, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of the anchors of rows of words: index among all words, hash, and begin and end of the windows that pick it."""
    total, span = len(hashes), window - anchor + 1
    if total < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = gram_hashes(hashes, anchor) | np.uint64(1)
    least = sliding(grams, span, np.minimum)  # by a window's first word
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    least = np.where(np.arange(len(least)) + window <= ends, least, np.uint64(0))
    padded = np.r_[np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]
    at = np.flatnonzero(sliding(padded, span, np.maximum)[: len(grams)] == grams)
    found = grams[at]
    first, last = np.full(len(at), total), np.zeros(len(at), np.int64)
    for back in range(span):  # the windows that pick an anchor follow one another
        picked = padded[at - back + span - 1] == found
        first = np.where(picked, at - back, first)
        last = np.where(picked & (last == 0), at - back + 1, last)
    return at, found, first, last - 1 + window


def segment_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the words from ``start`` to ``end`` and of the anchor's place among them."""
    base = 0x9E3779B97F4A7C15
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), base, np.uint64)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), pow(base, -1, 1 << 64), np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(mix(hashes) * powers[:-1], dtype=np.uint64)]
    shape = (end - start).astype(np.uint64) * np.uint64(1 << SPOT_BITS) + (at - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * inverse[start] + mix(shape))


#: The lowest bits of all digits of a word, of its first 0 to 16 digits; each digit in all places of a word.
ONES = 0x1111111111111111
BELOW = np.array([ONES & ((1 << 4 * i) - 1) for i in range(17)], np.uint64)
SAME = np.array([ONES * d for d in range(16)], np.uint64)


class WaveletMatrix:
    """A sequence of symbols as a wavelet matrix over digits of four bits, sixteen to a word, with sampled ranks.

    Ranks are kept for each 256 places whole and for each 32 as the rest in a
    byte; the places in between are counted. A level takes 1.25 bytes a symbol.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        self.shifts = list(range(4 * ((max(1, int(size - 1).bit_length()) + 3) // 4 - 1), -1, -4))
        self.words, self.far, self.near, self.smaller = [], [], [], []
        parts = len(symbols) // 256 + 1
        place = np.arange(len(symbols)) >> 5
        lift = (4 * np.arange(16)).astype(np.uint64)
        for shift in self.shifts:
            digit = (symbols >> shift & 15).astype(np.uint8)
            padded = np.zeros(256 * parts, np.uint64)
            padded[: len(digit)] = digit
            self.words.append(np.bitwise_or.reduce(padded.reshape(-1, 16) << lift, axis=1))
            counts = np.bincount(place * 16 + digit, minlength=128 * parts).reshape(-1, 16)
            before = np.cumsum(counts, axis=0) - counts
            far = before[::8]
            self.far.append(far.astype(np.int32).ravel())
            self.near.append((before - np.repeat(far, 8, axis=0)).astype(np.uint8).ravel())
            total = counts.sum(0)
            self.smaller.append(np.cumsum(total) - total)
            symbols = symbols[np.argsort(digit, kind="stable")]

    def follow(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the first ``place`` entries that equal ``symbol`` end among the sorted leaves."""
        for shift, words, far, near, smaller in zip(self.shifts, self.words, self.far, self.near, self.smaller, strict=True):
            digit, block, rest = symbol >> shift & 15, place >> 5, place & 31
            equal = np.zeros(len(place), np.int64)
            for word, below in ((2 * block, np.minimum(rest, 16)), (2 * block + 1, np.maximum(rest - 16, 0))):
                other = words[word] ^ SAME[digit]
                other |= other >> np.uint64(2)
                other |= other >> np.uint64(1)
                equal += np.bitwise_count(~other & BELOW[below])
            place = smaller[digit] + far[(place >> 8) * 16 + digit] + near[block * 16 + digit] + equal
        return place


class FMIndex:
    """Segments (rows of words as symbols from 1 on, each ended by 0) with weights (2 stands for more), to be searched backwards.

    Sorting the suffixes tells on its way which runs of PROBE words have weight
    2 or more; where one has not, no longer one over it can.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, weight: np.ndarray, size: int, depth: int):
        n = len(text)
        last = np.searchsorted(owner, owner, "right") - 1  # the place of each segment's 0
        rank, width, classes = text.astype(np.int64), 1, 0
        order = np.argsort(rank, kind="stable")
        while width < depth:
            ahead = np.arange(n) + width
            key = rank * np.int64(n + size + 1) + np.where(ahead <= last, rank[np.minimum(ahead, n - 1)], 0)
            order = np.argsort(key, kind="stable" if 2 * width >= depth else None)  # ties count in the last order only
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
            width *= 2
            if width == PROBE:  # the suffixes' classes by their first PROBE words
                self.probe = (np.bincount(rank, weight[owner])[rank] >= 2) | (np.arange(n) + PROBE > last)
            before, classes = classes, int(rank[order[-1]])
            if width >= PROBE and classes == before:  # what is equal so far is equal to the end
                order = np.argsort(rank, kind="stable")
                break
        self.first = np.searchsorted(text[order], np.arange(size + 2))  # of each symbol among the suffixes
        previous = np.where((order > 0) & (owner[order - 1] == owner[order]), text[order - 1], 0)
        self.matrix = WaveletMatrix(previous, size)
        self.start = self.matrix.follow(np.arange(size), np.zeros(size, np.int64))
        self.heavy = np.r_[weight[owner[order]] >= 2, False]

    def extend(self, symbol, low, high):
        shift = self.first[symbol] - self.start[symbol]
        ends = self.matrix.follow(np.r_[symbol, symbol], np.r_[low, high])
        return ends[: len(symbol)] + shift, ends[len(symbol) :] + shift

    def symbol(self, symbol):
        """The interval of the suffixes that begin with a symbol."""
        return self.first[symbol], self.first[symbol + 1]

    def twice(self, low, high):
        """Whether an interval's suffixes weigh 2 or more together."""
        return (high - low >= 2) | ((high - low == 1) & self.heavy[low])


def repeated(index: FMIndex, text: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray, ask: np.ndarray, anchor: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, end) of the maximal stretches of ``window`` words or more around the anchor with weight 2 or more.

    All segments in ``ask`` are searched at once, between the nearest runs on either side
    of the anchor that occur only once. A search reads back from an end until
    the weight falls below 2; no window over that place can match, so the next
    search starts at the end of the next window that can.
    """
    found: list[np.ndarray] = []
    everywhere = np.arange(len(text))
    probe = index.probe if window >= PROBE else np.ones(len(text), bool)
    lone_before = np.maximum.accumulate(np.where(probe, -1, everywhere))
    lone_after = np.minimum.accumulate(np.where(probe, 2 * len(text), everywhere)[::-1])[::-1]
    floor = np.maximum(0, lone_before[start + place] - start + 1)
    end = np.minimum(length, lone_after[start + place] - start + PROBE - 1)
    live = np.flatnonzero(ask & (end - floor >= window))
    end, least = end[live], np.maximum(place[live] + anchor, floor[live] + window)
    at = end - 1
    low, high = index.symbol(text[start[live] + at])
    while len(live):
        lower, higher = index.extend(text[start[live] + at - 1], low, high)
        on = index.twice(lower, higher)
        at = at - on
        low, high = np.where(on, lower, low), np.where(on, higher, high)
        whole = on & (at == floor[live])
        over = ~on | whole
        hit = over & (end - at >= window)
        if hit.any():
            found.append(np.c_[live[hit], at[hit], end[hit]])
        if over.any():
            following = np.minimum(end - 1, at + window - 1)
            stay = ~over | (~whole & (following >= least))
            end, at = np.where(over, following, end), np.where(over, following - 1, at)
            live, end, at, low, high, over, least = live[stay], end[stay], at[stay], low[stay], high[stay], over[stay], least[stay]
            low[over], high[over] = index.symbol(text[start[live[over]] + at[over]])
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return out[:, 0], out[:, 1], out[:, 2]


def search_shard(segments: pa.Array, places: np.ndarray, weight: np.ndarray, anchor_ids: np.ndarray, ask: np.ndarray, window: int, anchor: int):
    """(segment, first, end) for those of one shard's segments that are asked for, given each anchor's place and number from 0."""
    offsets, codes, distinct = words_of(segments)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    text = np.zeros(len(codes) + len(lengths), np.int64)
    start = offsets[:-1] + np.arange(len(lengths))
    inside = np.ones(len(text), bool)
    inside[start + lengths] = False
    text[inside] = codes.astype(np.int64) + 1
    text[start + places] = len(distinct) + 1 + anchor_ids
    size = int(len(distinct) + 2 + anchor_ids.max())
    index = FMIndex(text, owner, weight, size, max(PROBE, int(lengths.max()) + 1))
    return repeated(index, text, start, lengths, places, ask, anchor, window)


def row_key():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.coalesce("text", F.lit("")))


def anchor_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, segment, key, spot) for every anchor; the spot has its word's number in the row, its place in its segment and the segment's length."""

    def run(batches):
        for batch in slices(batches):
            offsets, codes, distinct = words_of(batch.column("text"))
            if not len(codes):
                continue
            hashes = hash_words(distinct)[codes]
            at, found, begin, end = anchors(offsets, hashes, window, anchor)
            row = np.searchsorted(offsets, at, "right") - 1
            whole = segment_hashes(hashes, begin, end, at) if len(at) else np.empty(0, np.uint64)
            spot = (at - offsets[row] << 2 * SPOT_BITS) | (at - begin << SPOT_BITS) | (end - begin)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(whole.view(np.int64)), batch.column("key").take(pa.array(row)), pa.array(spot)], names=["anchor", "segment", "key", "spot"])

    return rows.select("key", "text").mapInArrow(run, "anchor long, segment long, key long, spot long")


def repeated_anchors(found: DataFrame) -> DataFrame:
    """The rows of anchors that occur twice or more.

    Reads each partition, sorted by anchor, as a stream; an anchor with very
    many rows is passed on as it comes.
    """

    def run(batches):
        names = ["anchor", "segment", "key", "spot"]
        for piece, columns in whole_groups(batches, names, GATHERED):
            a = columns[0]
            same = a[1:] == a[:-1]
            kept = np.ones(len(a), bool) if piece else np.r_[False, same] | np.r_[same, False]
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in columns], names=names)

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, segment long, key long, spot long")


def segment_texts(rows: DataFrame, wanted: DataFrame, anchor: int, beside: int) -> DataFrame:
    """(deal, anchor, segment, copy, weight, place, words) of the ``wanted`` segments (key, spots: array of spot, anchor, segment, copy, weight, hot).

    ``deal`` is the anchor; with ``hot`` there is a row for the ``beside`` words
    after the anchor and one for those before it, as far as the segment has them.
    """

    def run(batches):
        mask = (1 << SPOT_BITS) - 1
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], [], []]
            for text, spots in zip(*(batch.column(k).to_pylist() for k in ("text", "spots")), strict=True):
                words = (text or "").encode().split()
                for x in spots:
                    at, place, length = x["spot"] >> 2 * SPOT_BITS, x["spot"] >> SPOT_BITS & mask, x["spot"] & mask
                    own = words[at - place : at - place + length]
                    sides = [own[place + anchor : place + anchor + beside], own[max(0, place - beside) : place]] if x["hot"] else []
                    deals = [hash_words(pa.array([b" ".join(side)]), x["anchor"] & 0xFFFFFFFF)[0].view(np.int64) for side in sides if len(side) == beside] if x["hot"] else [x["anchor"]]
                    for deal in deals:
                        for column, value in zip(out, (deal, x["anchor"], x["segment"], x["copy"], x["weight"], place, b" ".join(own)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["deal", "anchor", "segment", "copy", "weight", "place", "words"])

    found = asked_for(rows.select("key", "text"), wanted).join(wanted, "key").select("spots", "text")
    return found.mapInArrow(run, "deal long, anchor long, segment long, copy int, weight int, place int, words binary")


def shard_spans(segments: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, segment, first, end): stretches of a class's words that occur twice or more, from the begin of the segment."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        shard = pa.Table.from_batches(parts)
        # A row that stands twice in the table gives its segments twice, and a hot anchor's come from both sides.
        names = [shard[c].to_numpy() for c in ("copy", "segment", "anchor")]
        order = np.lexsort(names)
        new = np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in names], axis=0)]
        shard = shard.take(pa.array(order[new])).combine_chunks()
        places, segment, anchors_of = shard["place"].to_numpy().astype(np.int64), shard["segment"].to_numpy(), shard["anchor"].to_numpy()
        ids = np.unique(anchors_of, return_inverse=True)[1].astype(np.int64)
        words = shard["words"].combine_chunks().cast(pa.string())
        which, first, end = search_shard(words, places, shard["weight"].to_numpy(), ids, shard["copy"].to_numpy() == 0, window, anchor)
        yield pa.RecordBatch.from_arrays([pa.array(anchors_of[which]), pa.array(segment[which]), pa.array(first), pa.array(end)], names=["anchor", "segment", "first", "end"])
        del parts, shard, words, which, first, end
        release()

    return segments.mapInArrow(run, "anchor long, segment long, first long, end long")


def repeats(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(key, spans: array of first and end word) for rows (key, text) with repeated stretches."""
    found = cut(repeated_anchors(anchor_rows(rows, window, anchor)))
    one = F.struct("key", "spot")
    classes = found.groupBy("anchor", "segment").agg(F.min(one).alias("one"), F.max(one).alias("two"), F.count(F.lit(1)).alias("n"))
    # Of a class's two occurrences both are read; one row that stands twice is one text that weighs two.
    alone = F.col("one") == F.col("two")
    both = F.when(alone, F.array(F.struct(F.lit(0).alias("copy"), F.col("one").alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("copy"), F.col("one").alias("at")), F.struct(F.lit(1).alias("copy"), F.col("two").alias("at"))))
    weight = F.when(alone & (F.col("n") > 1), 2).otherwise(1)
    spots = cut(classes.select("anchor", "segment", weight.alias("weight"), F.explode(both).alias("x")).select("anchor", "segment", "weight", "x.copy", "x.at.*"))
    total = spots.count()
    hot = spots.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD_SEGMENTS).select("anchor", F.lit(True).alias("hot"))
    marked = spots.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = cut(marked.groupBy("key").agg(F.collect_list(F.struct("spot", "anchor", "segment", "copy", "weight", "hot")).alias("spots")))
    shards = max(1, -(-total // SHARD_SEGMENTS))
    texts = segment_texts(rows, wanted, anchor, (window - anchor + 1) // 2)
    judged = shard_spans(texts.repartition(shards, "deal"), window, anchor).groupBy("anchor", "segment").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    begin = F.shiftright("spot", 2 * SPOT_BITS) - F.shiftright("spot", SPOT_BITS).bitwiseAND((1 << SPOT_BITS) - 1)
    members = found.join(cut(judged), ["anchor", "segment"]).select("key", begin.alias("begin"), F.explode("spans").alias("x"))
    return members.groupBy("key").agg(F.collect_list(F.struct((F.col("begin") + F.col("x.first")).alias("first"), (F.col("begin") + F.col("x.end")).alias("end"))).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, by one space) and spans (removed words), a row for each of ``docs``.

    Null and empty texts have no words. Very long texts are taken whole, each in
    a slice of its own. A repeated row is an occurrence of its own, so its long
    stretches go from both; equal windows (ties) all go. Other columns are not
    read, so their names can't clash. A window has less than 32,768 words.
    """
    if not anchor <= window < 1 << SPOT_BITS - 1:
        raise ValueError(f"a window has {anchor} words or more and less than {1 << SPOT_BITS - 1}")
    rows = docs.select("doc_id", "text").withColumn("key", row_key())
    kind = dict(rows.dtypes)["doc_id"]
    spans = cut(repeats(rows, window, anchor))

    def run(batches):
        for batch in slices(batches):
            total, removed, kept, gone = [], [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                if own:
                    pairs = np.array([(s["first"], s["end"]) for s in own])
                    np.add.at(cover, pairs[:, 0], 1)
                    np.add.at(cover, pairs[:, 1], -1)
                out = np.cumsum(cover)[:-1] > 0
                edge = np.diff(np.r_[False, out, False].astype(np.int8))
                total.append(len(words))
                removed.append(int(out.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~out)] if own else words))
                gone.append([{"first": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(gone, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    # Only texts with something to remove are sent; the filter may let others pass.
    marked = asked_for(rows, spans, "asked")
    some = marked.filter("asked").join(spans, "key", "left").select("doc_id", "text", "spans")
    none = marked.filter("not asked").select("doc_id", "text", F.lit(None).cast("array<struct<first:long,end:long>>").alias("spans"))
    return some.unionByName(none).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string, spans array<struct<first:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
