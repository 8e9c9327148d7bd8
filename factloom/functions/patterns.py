"""Regular expressions as columns: case-insensitive unless a pattern asks otherwise, with Unicode word classes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE, KEEP = "(?iU)", "(?U)"


def has(text: Column, pattern: str, flags: str = IGNORE) -> Column:
    return text.rlike(flags + pattern)


def swap(text: Column, pattern: str, new: str, flags: str = IGNORE) -> Column:
    return F.regexp_replace(text, flags + pattern, new)


def find_all(text: Column, pattern: str, group: int = 0, flags: str = IGNORE) -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def words(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(rows: DataFrame, kept: list, values: Column, name: str, place: str | None = None) -> DataFrame:
    """``kept`` and a row for each of ``values``, which are made once.

    An inner explode makes Spark infer a filter that they aren't empty and push
    it down with the whole expression in it, lambdas' outer columns written out
    for each element; an outer one, filtered after, is left alone.
    """
    if place is None:
        return rows.select(*kept, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())
    return rows.select(*kept, F.posexplode_outer(values).alias(place, name)).filter(F.col(place).isNotNull())


def once(rows: DataFrame, keys: dict[str, Column], made) -> DataFrame:
    """``rows`` with the columns that ``made`` adds to a table of ``keys``, made once for each distinct combination of their values.

    Texts repeat, and a file of small rows is few partitions: the distinct ones
    are dealt evenly, and what is made of them is joined back, nulls as values.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = made(rows.select(*(k.alias(n) for n, k in keys.items())).distinct().repartition(parts))
    new = [c for c in added.columns if c not in keys]
    right = added.select(*(F.col(n).alias(f"__key_{n}") for n in keys), *new)
    left = rows.withColumns({f"__asked_{n}": k for n, k in keys.items()})
    same = [F.col(f"__asked_{n}").eqNullSafe(F.col(f"__key_{n}")) for n in keys]
    return left.join(right, same).select(*rows.columns, *new)


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with ``value`` computed before what uses it: beside Python functions Spark would write it out for each use."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def one_of(phrases: Iterable[str]) -> str:
    """A pattern of what any of ``phrases`` is in, with common beginnings tried once."""
    import re

    begins: dict[str, list[str]] = {}
    for phrase in phrases:
        begins.setdefault(phrase[:1], []).append(phrase[1:])
    if "" in begins:  # a phrase ends here, and whatever goes on has it
        return ""
    parts = [re.escape(first) + one_of(rest) for first, rest in begins.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def whole(surface: str) -> str:
    """A surface form that no letter a-z touches on either side."""
    import re

    return rf"(?<![a-z]){re.escape(surface)}(?![a-z])"


def any_of(surfaces: Iterable[str]) -> str:
    import re

    return rf"(?<![a-z])(?:{'|'.join(re.escape(s) for s in surfaces)})(?![a-z])"
