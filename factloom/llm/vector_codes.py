"""Vector code compression: product codes by Lloyd's rounds that rescan only what may have changed.

Vectors become integers and are cut into parts; each part position has a
codebook. A task keeps its vectors in chunks, and for each part position and
entry a heap of the vectors assigned there, keyed by how much nearer that entry
is than the second nearest (lower bound minus upper bound of the distances),
plus the entry's drift up to then. When entries move, an entry's drift grows by
its own way and the longest way of another one; only vectors at the top of a
heap whose key that has reached can have a nearer entry now. They are popped,
compared with all entries in exact integers, and pushed to their entry's heap.
What changes hands is added up by Spark; codebooks, of fixed size, are all that
the driver holds.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, release

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a chunk; a row of the state.
CHUNK = 4096
#: Larger components would not leave squared distances of long vectors exact.
LARGEST = 1 << 24
#: Share by which bounds are widened, far over what rounding can take from them.
SLACK = 1e-6
STATE = "ids binary, labels binary, vectors binary, counts binary, members binary, keys binary, changes array<struct<at:int,by:long>>"
CODED = "vec_id long, label long, code string, error long, scanned long"


def kept_vectors(rows: DataFrame, parts: int) -> DataFrame:
    """vec_id, vector (integers) and label of the rows whose vectors can be coded."""
    size = F.size("embedding")
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < LARGEST))
    rows = rows.filter(F.col("embedding").isNotNull() & (size > 0) & (size % parts == 0) & fit)
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.col("label").cast("long").alias("label"))


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, the lowest of equals, and how much farther the second nearest is at least."""
    distance = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    found = distance.argmin(1)
    at = np.arange(len(points))
    best = np.sqrt(distance[at, found].astype(float))
    distance[at, found] = np.iinfo(np.int64).max
    second = np.sqrt(distance.min(1).astype(float))
    return found, second * (1 - SLACK) - best * (1 + SLACK)


def low(key: np.ndarray) -> np.ndarray:
    """Keys of 32 bits that aren't greater."""
    return np.nextafter(key.astype(np.float32), np.float32(-np.inf))


class Chunk:
    """Some vectors with a heap for each part position and entry."""

    def __init__(self, vectors: np.ndarray, parts: int, entries: int):
        self.vectors, self.parts, self.width = vectors, parts, vectors.shape[1] // parts
        self.heaps: list[list[list[tuple[float, int]]]] = [[[] for _ in range(entries)] for _ in range(parts)]
        self.changes = np.zeros((parts, entries, self.width + 1), np.int64)
        self.scanned = 0

    @classmethod
    def stored(cls, row: dict, parts: int, entries: int) -> Chunk:
        members = np.frombuffer(row["members"], np.uint16).reshape(parts, -1)
        keys = np.frombuffer(row["keys"], np.float32).reshape(parts, -1)
        ends = np.cumsum(np.frombuffer(row["counts"], np.uint16).reshape(parts, entries), axis=1, dtype=np.int64)
        out = cls(np.frombuffer(row["vectors"], np.int32).reshape(members.shape[1], -1), parts, entries)
        for p in range(parts):
            held, first = list(zip(keys[p].tolist(), members[p].tolist(), strict=True)), 0
            for e, last in enumerate(ends[p].tolist()):
                out.heaps[p][e], first = held[first:last], last
        return out

    def store(self) -> dict:
        flat = [[x for heap in part for x in heap] for part in self.heaps]
        at = np.flatnonzero(self.changes)
        return {
            "vectors": self.vectors.astype(np.int32).tobytes(),
            "counts": np.array([[len(heap) for heap in part] for part in self.heaps], np.uint16).tobytes(),
            "members": np.array([[i for _, i in part] for part in flat], np.uint16).tobytes(),
            "keys": np.array([[k for k, _ in part] for part in flat], np.float32).tobytes(),
            "changes": [{"at": int(i), "by": int(v)} for i, v in zip(at, self.changes.reshape(-1)[at], strict=True)],
        }

    def points(self, p: int, members) -> np.ndarray:
        return self.vectors[members, p * self.width : (p + 1) * self.width].astype(np.int64)

    def tell(self, p: int, entries: np.ndarray, points: np.ndarray, sign: int) -> None:
        np.add.at(self.changes[p], entries, sign * np.c_[points, np.ones(len(points), np.int64)])

    def first(self, books: np.ndarray) -> None:
        """Assigns all parts."""
        every = np.arange(len(self.vectors))
        for p in range(self.parts):
            points = self.points(p, every)
            found, slack = nearest(points, books[p])
            self.scanned += len(points)
            self.tell(p, found, points, 1)
            for e, key, i in zip(found.tolist(), low(slack).tolist(), every.tolist(), strict=True):
                self.heaps[p][e].append((key, i))
            for heap in self.heaps[p]:
                heapify(heap)

    def again(self, books: np.ndarray, drift: np.ndarray) -> None:
        """Assigns the parts anew whose bounds ``drift`` has violated."""
        for p, heaps in enumerate(self.heaps):
            members, old = [], []
            for e, limit in enumerate((drift[p] * (1 + SLACK)).tolist()):
                heap = heaps[e]
                while heap and heap[0][0] <= limit:
                    members.append(heappop(heap)[1])
                    old.append(e)
            if not members:
                continue
            points, was = self.points(p, members), np.array(old)
            found, slack = nearest(points, books[p])
            self.scanned += len(points)
            moved = found != was
            self.tell(p, was[moved], points[moved], -1)
            self.tell(p, found[moved], points[moved], 1)
            for e, key, i in zip(found.tolist(), low(slack + drift[p][found]).tolist(), members, strict=True):
                heappush(heaps[e], (key, i))

    def codes(self) -> np.ndarray:
        out = np.empty((len(self.vectors), self.parts), np.uint8)
        for p, heaps in enumerate(self.heaps):
            for e, heap in enumerate(heaps):
                out[[i for _, i in heap], p] = e
        return out


def chunked(vectors: DataFrame, books: np.ndarray, size: int) -> DataFrame:
    """The state after the first assignment."""
    parts, entries, width = books.shape

    def rows_of(batches):
        """Ids, labels and vectors, ``size`` at most."""
        held, count = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                piece = batch.slice(start, size)
                held.append(piece)
                count += piece.num_rows
                while count >= size:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    yield whole.slice(0, size)
                    held, count = whole.slice(size).to_batches(), count - size
        if count:
            yield pa.Table.from_batches(held)

    def run(batches):
        for piece in rows_of(batches):
            matrix = pa.concat_arrays([c.flatten() for c in piece.column("vector").chunks]).to_numpy(zero_copy_only=False).reshape(piece.num_rows, parts * width)
            chunk = Chunk(matrix, parts, entries)
            chunk.first(books)
            ids, labels = (serial(piece.column(c)) for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_pylist([{"ids": ids, "labels": labels, **chunk.store()}], schema=SCHEMA)
        release()

    return vectors.mapInArrow(run, STATE)


SCHEMA = pa.schema([*((c, pa.binary()) for c in ("ids", "labels", "vectors", "counts", "members", "keys")), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("by", pa.int64())])))])


def serial(column: pa.ChunkedArray) -> bytes:
    """Whole numbers as eight bytes each, the nulls after them as one byte each."""
    return column.fill_null(0).to_numpy().astype(np.int64).tobytes() + column.is_null().to_numpy().astype(np.uint8).tobytes()


def parsed(data: bytes) -> pa.Array:
    n = len(data) // 9
    return pa.array(np.frombuffer(data[: 8 * n], np.int64), mask=np.frombuffer(data[8 * n :], np.uint8).astype(bool))


def reassigned(state: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    parts, entries, _ = books.shape

    def run(batches):
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                chunk = Chunk.stored(row, parts, entries)
                chunk.again(books, drift)
                yield pa.RecordBatch.from_pylist([{"ids": row["ids"], "labels": row["labels"], **chunk.store()}], schema=SCHEMA)
        release()

    return state.mapInArrow(run, STATE)


def coded(state: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The last assignment, a row for each vector: vec_id, label, code, error, and scanned, its chunk's rescanned parts on the first of its rows."""
    parts, entries, width = books.shape

    def run(batches):
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                chunk = Chunk.stored(row, parts, entries)
                chunk.again(books, drift)
                codes, n = chunk.codes(), len(chunk.vectors)
                entries_of = books[np.arange(parts), codes].reshape(n, -1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [
                        parsed(row["ids"]), parsed(row["labels"]), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()),
                        pa.array(((chunk.vectors.astype(np.int64) - entries_of) ** 2).sum(1)), pa.array(np.r_[chunk.scanned, np.zeros(n - 1, np.int64)]),
                    ],
                    names=["vec_id", "label", "code", "error", "scanned"],
                )
        release()

    return state.mapInArrow(run, CODED)


class Books:
    """Codebooks with what is assigned to each entry, and how far entries have drifted."""

    def __init__(self, first: np.ndarray):
        self.entries = first
        self.sums = np.zeros((*first.shape[:2], first.shape[2] + 1), np.int64)
        self.drift = np.zeros(first.shape[:2])

    def move(self, state: DataFrame) -> None:
        """To the floors of the means, from ``state``'s changes; one row for each number of the codebooks comes to the driver."""
        flat = self.sums.reshape(-1)
        for at, by in state.select(F.explode("changes").alias("x")).groupBy("x.at").agg(F.sum("x.by")).collect():
            flat[at] += by
        count = self.sums[..., -1:]
        new = np.where(count > 0, self.sums[..., :-1] // np.maximum(count, 1), self.entries)
        way = np.sqrt(((new - self.entries) ** 2).sum(2).astype(float))
        order = np.sort(way, axis=1)
        farthest = np.broadcast_to(order[:, -1:], way.shape).copy()
        farthest[np.arange(len(way)), way.argmax(1)] = order[:, -2] if way.shape[1] > 1 else 0.0
        self.drift = self.drift + way + farthest
        self.entries = new

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK) -> tuple[DataFrame, Books | None]:
    """vec_id, label, code, error and scanned for each vector of ``rows`` (vec_id, embedding, label) that can be coded, and the codebooks (none without vectors).

    Null vectors and those with null or non-finite components are left out; so
    are empty ones, those whose length is no multiple of ``parts`` or isn't that
    of the vector with the smallest vec_id, and those with components of 65,536
    or more, whose distances would not be exact. A codebook begins with the
    vectors of the smallest vec_ids, null last, equal ones by vector and label;
    with fewer vectors than ``entries`` it has fewer entries. Repeated rows are
    coded each. A null label is a label. Other columns are not read.
    """
    if not 0 < entries <= 256 or not 0 < chunk < 1 << 16:
        raise ValueError("codes have one byte, and a chunk 65,535 vectors at most")
    vectors = kept_vectors(rows, parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector", "label").limit(entries).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], CODED), None
    size = len(first[0].vector)
    begin = np.array([r.vector for r in first if len(r.vector) == size], np.int64)
    vectors = vectors.filter(F.size("vector") == size)
    if len(begin) < len(first):  # another length among the smallest ids
        begin = np.array([r.vector for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector", "label").limit(entries).collect()], np.int64)
    books = Books(begin.reshape(len(begin), parts, -1).transpose(1, 0, 2).copy())
    state = cut(chunked(vectors, books.entries, chunk))
    for k in range(rounds):
        if k:
            state = cut(reassigned(state, books.entries, books.drift))
        books.move(state)
    return cut(coded(state, books.entries, books.drift)), books


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (the sum over equal labels, null being one) and codebooks_sha256, as ``compress`` has them."""
    found, books = compress(rows, parts, entries, rounds)
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
