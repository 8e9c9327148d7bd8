"""A model as a scorer of (claim, passage) columns: loaded once by each worker, unavailable rather than wrong."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of each worker: a loaded model, or what kept it from loading, by name.
LOADED: dict[str, object] = {}
TYPE = "struct<entailment:double,contradiction:double,neutral:double,available:boolean,status:string>"


def model_of(name: str, load: Callable[[], Callable]):
    """The worker's model, loaded when first asked for; the error if it can't be."""
    if name not in LOADED:
        try:
            LOADED[name] = load()
        except Exception as error:  # noqa: BLE001  any failure makes the model unavailable, and rows say so
            LOADED[name] = error
    return LOADED[name]


def batch_scorer(name: str, load: Callable[[], Callable[[list[str], list[str]], list[tuple[float, float, float]]]], enabled: bool = True) -> Callable[[Column, Column], Column]:
    """A scorer of whole Arrow batches. ``load`` gives a function from passages and claims to (entailment, contradiction, neutral).

    Rows say disabled, failed or ready; a model that can't be loaded, or fails
    on a batch, leaves its rows unavailable with all weight on neutral.
    """

    @F.pandas_udf(TYPE)
    def run(claims: pd.Series, passages: pd.Series) -> pd.DataFrame:
        model, status = (model_of(name, load), "ready") if enabled else (None, "disabled")
        rows = None
        if isinstance(model, Exception):
            status = "failed"
        elif model is not None:
            try:
                rows = model(passages.fillna("").tolist(), claims.fillna("").tolist())
            except Exception:  # noqa: BLE001
                status = "failed"
        if rows is None:
            rows = [(0.0, 0.0, 1.0)] * len(claims)
        out = pd.DataFrame(rows, columns=["entailment", "contradiction", "neutral"]).astype(float)
        return out.assign(available=status == "ready", status=status)

    return lambda claim, passage: run(claim, passage)


def score_pairs(pairs: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """``pairs`` (claim, passage) with their scores; each distinct pair is scored once."""
    distinct = pairs.select("claim", "passage").distinct().withColumn("s", scorer(F.col("claim"), F.col("passage"))).select("claim", "passage", "s.*")
    return pairs.join(distinct, ["claim", "passage"])


def canonical(label: Column) -> Column:
    return F.when(label == "neutral", "unclear").otherwise(label)
