"""Stored checks and users that change by commits.

A table is a folder of Parquet files, each in a bucket of its key, and numbered
manifests that list them. Whoever reads takes the newest manifest, so a change
is seen as a whole or not at all: it writes files of the buckets it touches and
then one manifest, whose name only one writer can take. Files of a change that
failed are in no manifest; ``vacuum`` removes them.

Everything goes through Spark's own file systems, so any store that they reach
will do if it can create a file only where none is (or rename one so).
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.sources.history import documents

BUCKETS = 64


class Conflict(RuntimeError):
    """Another change was committed first."""


class Store:
    """A table at ``path`` whose rows are dealt into buckets by ``key``; ``schema`` is needed to begin one."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | StructType | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self.version() is None:
            if schema is None:
                raise ValueError(f"no table at {path}")
            kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
            self._commit(0, {"buckets": buckets, "schema": kind.json(), "files": {}})
        found = self.manifest()
        self.buckets, self.schema = found["buckets"], StructType.fromJson(json.loads(found["schema"]))

    # ---- manifests -------------------------------------------------------

    def versions(self) -> list[int]:
        where = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        at = self.version() if version is None else version
        stream = self._fs.open(self._path(f"{self.path}/manifests/{at:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, version: int, content: dict) -> None:
        """Takes the name of the next manifest: written aside, then renamed, which fails if the name is taken."""
        aside = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        named = self._path(f"{self.path}/manifests/{version:010d}.json")
        taken = self._fs.exists(named)
        if taken or not self._fs.rename(aside, named):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    # ---- reading ---------------------------------------------------------

    def bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def bucket_of(self, value) -> int:
        kind = self.schema[self.key].dataType
        return self.spark.range(1).select(self.bucket(F.lit(value).cast(kind))).first()[0]

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in files))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read([f for files in self.manifest(version)["files"].values() for f in files])

    def read_key(self, value) -> DataFrame:
        """The rows of one key, from its bucket's files alone."""
        found = self.manifest()["files"].get(str(self.bucket_of(value)), [])
        return self._read(found).filter(F.col(self.key) == F.lit(value))

    # ---- changing --------------------------------------------------------

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Files of ``rows`` by bucket: each is dealt to as many tasks as its rows need."""
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields)).withColumn("__bucket", self.bucket(self.key)).hint("rebalance", F.col("__bucket")).write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        out: dict[str, list[str]] = {}
        for folder in self._fs.listStatus(self._path(f"{self.path}/{name}")):
            where = folder.getPath()
            if where.getName().startswith("__bucket="):
                out[where.getName().split("=")[1]] = [f"{name}/{where.getName()}/{s.getPath().getName()}" for s in self._fs.listStatus(where) if s.getPath().getName().startswith("part-")]
        return out

    def append(self, rows: DataFrame, attempts: int = 5) -> int:
        """Adds ``rows``; the version with them. Appends don't exclude each other: after a conflict the files are listed in the next manifest."""
        new = self._write(rows)
        for left in reversed(range(attempts)):
            version = self.version()
            content = self.manifest(version)
            for b, files in new.items():
                content["files"][b] = [*content["files"].get(b, []), *files]
            try:
                self._commit(version + 1, content)
                return version + 1
            except Conflict:
                if not left:
                    raise
        raise Conflict(self.path)

    def rewrite(self, change, buckets: list[int]) -> int:
        """Replaces the rows of ``buckets`` by ``change`` of them; other buckets' files stay. Fails if anything was committed meanwhile."""
        version = self.version()
        content = self.manifest(version)
        touched = [str(b) for b in buckets]
        new = self._write(change(self._read([f for b in touched for f in content["files"].get(b, [])])))
        if set(new) - set(touched):
            raise ValueError("a change may not move rows to other buckets")
        content["files"] = {**{b: f for b, f in content["files"].items() if b not in touched}, **new}
        self._commit(version + 1, content)
        return version + 1

    def delete(self, value, condition) -> int:
        """Removes the rows of a key that fit ``condition``; how many. Without any nothing is committed."""
        def those():
            return (F.col(self.key) == F.lit(value)) & F.coalesce(condition, F.lit(False))

        gone = self.read_key(value).filter(those()).count()
        if gone:
            self.rewrite(lambda rows: rows.filter(~F.coalesce(those(), F.lit(False))), [self.bucket_of(value)])
        return gone

    def insert_new(self, rows: DataFrame) -> int:
        """Adds the rows of keys that aren't there yet, the least row of each key; how many. Only the buckets of ``rows`` are read."""
        rest = [c for c in self.schema.names if c != self.key]
        first = rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(F.struct(*rest)).alias("__one")).select(self.key, "__one.*").select(*self.schema.names)
        version = self.version()
        content = self.manifest(version)
        asked = [str(r[0]) for r in first.select(self.bucket(self.key)).distinct().collect()]  # as many as there are buckets at most
        there = self._read([f for b in asked for f in content["files"].get(b, [])]).select(self.key)
        new = self._write(first.join(there, self.key, "left_anti"))
        if not new:
            return 0
        for b, files in new.items():
            content["files"][b] = [*content["files"].get(b, []), *files]
        self._commit(version + 1, content)
        return self._read([f for files in new.values() for f in files]).count()

    def vacuum(self, keep_versions: int = 1, older_than_s: float = 3600.0) -> int:
        """Removes files that no kept manifest names and no running change can still be writing; how many."""
        versions = self.versions()
        kept = {f for v in versions[-keep_versions:] for files in self.manifest(v)["files"].values() for f in files}
        where, removed = self._path(f"{self.path}/data"), 0
        for folder in self._fs.listStatus(where) if self._fs.exists(where) else []:
            for bucket in (x.getPath() for x in self._fs.listStatus(folder.getPath()) if x.isDirectory()):
                for s in self._fs.listStatus(bucket):
                    name = f"data/{folder.getPath().getName()}/{bucket.getName()}/{s.getPath().getName()}"
                    if name not in kept and s.getModificationTime() < (time.time() - older_than_s) * 1000:
                        removed += self._fs.delete(s.getPath(), True)
        for v in versions[:-keep_versions]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:010d}.json"), False)
        return removed


def checks_store(spark: SparkSession, path: str, checks: DataFrame | None = None) -> Store:
    """Checks by their owner; ``checks`` gives the columns of a new table."""
    return Store(spark, path, "userId", None if checks is None else documents(checks).schema)


def add_checks(store: Store, checks: DataFrame) -> bool:
    """Stores checks of known users; whether that worked, since a failed write must not fail the check."""
    try:
        store.append(documents(checks))
    except Exception:  # noqa: BLE001
        return False
    return True


def delete_stored_check(store: Store, user, check_id) -> int:
    """1 if a check of its owner went, else 0: its bucket alone is written anew."""
    return store.delete(user, F.col("checkId") == F.lit(check_id))


def find_or_add_user(store: Store, new: DataFrame) -> DataFrame:
    """The stored rows of ``new``'s users, who are added unless they are there."""
    store.insert_new(new)
    return store.read().join(new.select(store.key).distinct(), store.key, "left_semi")
