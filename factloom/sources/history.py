"""History of checks: stored rows, pages of them, deletion, one row of detail, users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

PAGE, MOST = 50, 100


def paging(limit: str | int | None = None, skip: str | int | None = None) -> tuple[int, int]:
    """A limit from 1 to 100, 50 unless it is a number, and a skip from 0."""
    def number(value, otherwise):
        try:
            return int(value)
        except (TypeError, ValueError):
            return otherwise

    return max(1, min(MOST, number(limit, PAGE))), max(0, number(skip, 0))


def history_page(checks: DataFrame, user, limit=None, skip=None, columns: tuple[str, ...] = ("check_id", "statement", "combined_verdict", "combined_score", "created_at")) -> DataFrame:
    """A user's checks, the newest first; the filter reaches the scan, and the top rows are taken without a full sort."""
    limit, skip = paging(limit, skip)
    return checks.filter(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("check_id")).select(*columns).offset(skip).limit(limit)


def count_checks(checks: DataFrame) -> DataFrame:
    return checks.groupBy("user_id").agg(F.count(F.lit(1)).alias("checks"))


def detail(checks: DataFrame, user, check_id) -> DataFrame:
    """One check of its owner; nothing for an id that isn't one."""
    return checks.filter((F.col("check_id") == F.lit(check_id).try_cast("long")) & (F.col("user_id") == user))


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def renamed(kind: DataType) -> DataType:
    """A type with the stored names of its fields, at every depth."""
    if isinstance(kind, StructType):
        return StructType([StructField(camel(f.name), renamed(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(renamed(kind.elementType), kind.containsNull)
    return kind


def documents(checks: DataFrame) -> DataFrame:
    """``checks`` under their stored names, nested fields included; without those of anonymous users."""
    return checks.filter("user_id is not null").select(*(F.col(f"`{f.name}`").cast(renamed(f.dataType)).alias(camel(f.name)) for f in checks.schema.fields))


def save_checks(checks: DataFrame, path: str) -> bool:
    """Appends checks' documents, a folder for each user bucket; whether that worked, since a failed write must not fail the check."""
    try:
        documents(checks).withColumn("bucket", F.pmod(F.xxhash64("userId"), F.lit(64))).write.mode("append").partitionBy("bucket").parquet(path)
    except Exception:  # noqa: BLE001
        return False
    return True


def with_owner(checks: DataFrame, users: DataFrame) -> DataFrame:
    return checks.join(users, "user_id")


def delete_check(checks: DataFrame, user, check_id) -> tuple[DataFrame, DataFrame]:
    """(what stays, how many go): only a check of its owner goes."""
    gone = (F.col("check_id") == check_id) & (F.col("user_id") == user)
    return checks.filter(~F.coalesce(gone, F.lit(False))), checks.filter(gone).agg(F.count(F.lit(1)).alias("deleted"))


def with_user(users: DataFrame, new: DataFrame, key: str = "google_id") -> DataFrame:
    """``users`` and those of ``new`` whose key isn't there yet, the least row of each."""
    rest = [c for c in new.columns if c != key]
    first = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("__one")).select(key, "__one.*")
    return users.unionByName(first.join(users, key, "left_anti"))


def find_user(users: DataFrame, value, key: str = "google_id") -> DataFrame:
    """The row of a user, or none; the filter reaches the scan."""
    return users.filter(F.col(key) == F.lit(value))


def response(row: dict[str, Column]) -> Column:
    """The wire form: numbers rounded, as JSON."""
    return F.to_json(F.struct(*(F.round(c, 4).alias(n) if n in ("support", "contradiction", "net") else c.alias(n) for n, c in row.items())))
