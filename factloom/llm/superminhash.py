"""MinHash near-dedup with SuperMinHash signatures.

Each shingle draws a random permutation of the signature's places, one place a
step; the step it has come to, with a random fraction, is its rank there, and a
place keeps the least rank of all shingles. The ranks of one shingle are
correlated: it gives each place another whole number, so signatures vary less
than with a hash function for each place. Once every place has a rank of the
steps done, later steps can change nothing, so long texts stop after one or two.

Runs of ROWS places make bands. Sets that agree in a band share a bucket; in a
bucket all are compared with its least and its greatest set first, which settles
large groups of copies, and what lies in different classes after that is bounded
by bitmaps in blocks. Every link is confirmed on full sets of shingles, and
links are grouped by union-find: nodes hook to their least neighbour, paths are
halved until they end at roots, links between roots go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, mix, slices
from factloom.llm.ngram_join import bitmap, bounded, merged, open_pairs, set_id, shingle_sets, tiled, verified

GRAM = 4
#: Sets link if their intersection has so many of 100 shingles of their union.
PERCENT = 80
#: Bands, and places of the signature in each: a pair at the limit misses all with a chance of (1 - 0.8 ** 4) ** 40, under 1e-9.
BANDS, ROWS = 40, 4
#: Bits of a rank's fraction, and of the number that chooses a place.
FRACTION, CHOICE = 40, 24
#: Shingles whose permutations a worker holds at once, PLACES bytes each.
TOGETHER = 1 << 17
NOTHING = np.uint64(2**64 - 1)


def draws(shingles: np.ndarray, step: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """What each shingle draws in a step: the index, from ``step`` on, of the place it takes, and its rank there."""
    x = mix(shingles + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64))
    index = step + ((x & np.uint64((1 << CHOICE) - 1)) * np.uint64(places - step) >> np.uint64(CHOICE)).astype(np.int64)
    return index, (x >> np.uint64(64 - FRACTION)) | np.uint64(step << FRACTION)


def signatures(sets: list[np.ndarray], places: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``places`` ranks for each set, none of them empty."""
    out = np.full((len(sets), places), NOTHING)
    ends = np.cumsum([len(s) for s in sets])
    first = 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TOGETHER, "right")))
        found = out[first:last].reshape(-1)
        shingles = np.concatenate(sets[first:last])
        of = np.repeat(np.arange(last - first), [len(s) for s in sets[first:last]])
        places_of = None
        for step in range(places):
            index, rank = draws(shingles, step, places)
            if not step:
                place = index
            else:
                at = np.arange(len(shingles))
                place = places_of[at, index].astype(np.int64)
                places_of[at, index] = places_of[:, step]
            np.minimum.at(found, of * places + place, rank)
            going = (found.reshape(-1, places) == NOTHING).any(1)
            if not going.any():
                break
            stay = going[of]
            if not step:
                shingles, of, index = shingles[stay], of[stay], index[stay]
                places_of = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(shingles), 1))
                places_of[np.arange(len(shingles)), index] = 0
            elif 2 * np.count_nonzero(stay) < len(stay):
                shingles, of, places_of = shingles[stay], of[stay], places_of[stay]
        first = last
    return out


def band_hashes(ranks: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each band of each signature, another one for each place of the band."""
    parts = ranks.reshape(len(ranks), bands, -1)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(parts.shape[2]):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return total


def sketched(rows: DataFrame, n: int, bands: int, band_rows: int) -> DataFrame:
    """For each of ``rows`` (doc_id, key, text): doc_id, key, n, sid (of its set), bits, and tiles, the hashes of its bands; copies in a task have those of the first only."""

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), n)
            sids = [set_id(s) for s in sets]
            new = [i for i, (s, k) in enumerate(zip(sets, sids, strict=True)) if len(s) and k not in seen and not seen.add(k)]
            bits: list = [None] * len(sets)
            tiles: list = [None] * len(sets)
            if new:
                found = band_hashes(signatures([sets[i] for i in new], bands * band_rows), bands).view(np.int64)
                for i, t in zip(new, found, strict=True):
                    bits[i], tiles[i] = bitmap(sets[i]), t
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int32()), pa.array(np.array(sids, np.uint64).view(np.int64)),
                    pa.array(bits, pa.binary()), pa.array(tiles, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n", "sid", "bits", "tiles"],
            )

    return rows.mapInArrow(run, "doc_id long, key long, n int, sid long, bits binary, tiles array<long>")


def stars(entries: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of each set with the least and the greatest one of each of its buckets."""
    centres = entries.groupBy("tile").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low <> high").select("tile", F.explode(F.array("low", "high")).alias("c"))
    return entries.join(centres, "tile").filter("sid <> c").select(F.least("sid", "c").alias("a"), F.greatest("sid", "c").alias("b")).distinct()


def mixed(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """(tile, sid, of): the sets of the buckets that hold sets of different classes, and how many those are.

    Classes are compared by aggregates, so buckets whose sets are all linked are never gathered.
    """
    named = entries.join(classes.select("sid", "class"), "sid")
    several = named.groupBy("tile").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("of")).filter("low <> high")
    return named.join(several.select("tile", "of"), "tile").select("tile", "sid", "of")


def near_duplicates(docs: DataFrame, n: int = GRAM, percent: int = PERCENT, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept (it is the own one), a row for each of ``docs``.

    Null and empty texts, and texts of white space, have no shingles, link with
    nothing and are kept. Very long texts are taken whole, each in a slice of
    its own. Repeated rows are put out each. Rows with equal doc_id count as one
    document: what links with one links with all. A row without doc_id has its
    size and no component, links nothing and isn't kept. A pair exactly as
    similar as the limit links. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("text"))
    every = cut(sketched(rows.select("doc_id", "key", "text"), n, bands, band_rows))
    filled = every.filter("n > 0 and doc_id is not null")
    # Copies may have come to different tasks, and rows without id may have come first: the tiles are those of any row.
    sketches = every.filter("tiles is not null").groupBy("sid").agg(F.first("bits").alias("bits"), F.first("tiles").alias("tiles"))
    ids = filled.groupBy("sid").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.min("doc_id").alias("least"))
    both = cut(ids.join(sketches, "sid"))
    sets = both.select("sid", "key", "n", "bits", "least", F.col("sid").alias("class"))
    entries = both.select("sid", F.explode("tiles").alias("tile"))
    texts = rows.filter("doc_id is not null")

    of_id = filled.groupBy("doc_id").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low <> high")
    same = filled.join(of_id, "doc_id").select(F.col("low").alias("a"), F.col("sid").alias("b")).filter("a <> b")
    classes = merged(sets, verified(cut(bounded(stars(entries), sets, percent)), texts, n, percent).unionByName(same))
    tiles = cut(tiled(cut(mixed(entries, classes)), sets))
    for best in (True, False):
        classes = merged(classes, verified(cut(open_pairs(tiles, classes, best, percent)), texts, n, percent))

    named = classes.join(classes.groupBy("class").agg(F.min("least").alias("component_id")), "class").select("sid", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    found = every.select("doc_id", "n", "sid").join(named, "sid", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
