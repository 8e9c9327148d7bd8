"""Candidates as a stream: the first of each url within a watermark, distinct titles with state by claim, and evidence counts by window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from factloom.functions import lexicon as L
from factloom.operators.search import title_key
from factloom.operators.titles import LEAST_TOKENS, PERCENT

#: The state store that processors with several state variables need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_by_url(candidates: DataFrame, late: str = "45 days") -> DataFrame:
    """Drops later rows with the same claim and url; state is kept for the watermark's span, not for ever."""
    return candidates.filter("url is not null and url <> ''").withWatermark("published", late).dropDuplicatesWithinWatermark(["claim_id", "url"])


def stance_counts(evidence: DataFrame, window: str = "1 day", late: str = "45 days") -> DataFrame:
    """Stances of each claim by window of publication."""
    return (
        evidence.withWatermark("published", late).groupBy(F.window("published", window).alias("w"), "claim_id")
        .agg(F.count_if(F.col("stance") == "supports").alias("supporting"), F.count_if(F.col("stance") == "contradicts").alias("contradicting"), F.count(F.lit(1)).alias("rows"))
        .select(F.col("w.start").alias("start"), "claim_id", "supporting", "contradicting", "rows")
    )


def say_opposite(a: set, b: set, turned: list) -> bool:
    return not (a ^ b).isdisjoint(L.POLARITY) or any(not a.isdisjoint(x) and not b.isdisjoint(y) for x, y in turned)


class TitleKeeper(StatefulProcessor):
    """A claim's seen urls and title keys, and the kept titles' tokens, until nothing has come for ``idle_ms`` of event time."""

    def __init__(self, columns: list[str], order: list[str], idle_ms: int, least_tokens: int, percent: int):
        self.columns, self.order, self.idle_ms, self.least_tokens, self.percent = columns, order, idle_ms, least_tokens, percent
        single = {e: {f for f in forms if " " not in f} for e, forms in L.EVENT_SURFACES.items()}
        self.turned = [(single[a], single[b]) for x, y in L.OPPOSITES for a, b in ((x, y), (y, x))]

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "name string", "at long")
        self.kept = handle.getListState("kept", "tokens string")
        self.ends = handle.getValueState("ends", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", na_position="first")
        kept = [set(k[0].split(" ")) for k in self.kept.get()]
        stay = []
        for at, url, name in zip(batch.index, batch["url"], batch["title_key_"], strict=True):
            if not url or self.seen.containsKey((f"u {url}",)):
                continue
            self.seen.updateValue((f"u {url}",), (0,))  # of a url the first row counts, whether it stays or not
            tokens = set(name.split(" "))
            if name and self.seen.containsKey((f"k {name}",)):
                continue
            if len(tokens) >= self.least_tokens:
                if any(100 * len(tokens & k) >= self.percent * len(tokens | k) and not say_opposite(tokens, k, self.turned) for k in kept):
                    continue
                kept.append(tokens)
                self.kept.appendValue((name,))
            if name:
                self.seen.updateValue((f"k {name}",), (0,))
            stay.append(at)
        last = batch["event_at_"].max()
        if not pd.isna(last):
            self.wait_until(int(last.timestamp() * 1000) + self.idle_ms)
        if stay:
            yield batch.loc[stay, self.columns]

    def wait_until(self, at: int) -> None:
        """One timer a claim, the latest."""
        if self.ends.exists():
            if self.ends.get()[0] >= at:
                return
            self.handle.deleteTimer(self.ends.get()[0])
        self.ends.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.seen, self.kept, self.ends):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def distinct_titles(candidates: DataFrame, order: tuple[str, ...] = ("job_order", "ord"), late: str = "45 days", idle_days: float = 90, least_tokens: int = LEAST_TOKENS, percent: int = PERCENT) -> DataFrame:
    """``candidates`` (claim_id, url, title, published, ``order`` and more) without repeated urls, title keys and near-copies of titles kept before, claim by claim.

    Rows are judged as they come, those of a batch in ``order``; what a claim
    has kept is state, which goes once the watermark is ``idle_days`` after its
    latest row. Rows without url go. The state needs STATE_STORE. A row's date
    of publication is its event time; rows later than ``late`` are dropped by
    the watermark, rows without one set no timer.
    """
    schema = StructType([f for f in candidates.schema.fields])
    rows = candidates.withColumn("event_at_", F.col("published")).withColumn("title_key_", title_key(F.col("title"))).withWatermark("event_at_", late)
    keeper = TitleKeeper(candidates.columns, list(order), int(idle_days * 86_400_000), least_tokens, percent)
    return rows.groupBy("claim_id").transformWithStateInPandas(statefulProcessor=keeper, outputStructType=schema, outputMode="Append", timeMode="EventTime")
