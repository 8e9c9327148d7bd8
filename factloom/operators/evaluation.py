"""Evaluation of scores (doc_id, y, p): thresholds, confusion, curves, calibration, resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.features import positions


def grid(spark, values, name: str = "threshold") -> DataFrame:
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def confusion(scores: DataFrame, threshold: Column | float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    hit, true = F.col("p") >= threshold, F.col("y") == 1
    cells = (("tp", hit & true), ("fp", hit & ~true), ("fn", ~hit & true), ("tn", ~hit & ~true))
    return scores.groupBy(*by).agg(*(F.count_if(test).alias(name) for name, test in cells))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def metrics(cells: DataFrame) -> DataFrame:
    """``cells`` with accuracy, precision, recall and f1; 0 where there is nothing to divide by."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def by_score(scores: DataFrame) -> DataFrame:
    """p, n and pos: one row for each distinct score. Curves need no more."""
    return scores.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))


def at_thresholds(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """threshold, tp, fp, fn, tn for each threshold: distinct scores against a grid of a few hundred values."""
    hit = F.col("p") >= F.col("threshold")
    neg = F.col("n") - F.col("pos")
    zero = lambda test, of: F.coalesce(F.sum(F.when(test, of)), F.lit(0))
    return by_score(scores).crossJoin(F.broadcast(thresholds)).groupBy("threshold").agg(zero(hit, F.col("pos")).alias("tp"), zero(hit, neg).alias("fp"), zero(~hit, F.col("pos")).alias("fn"), zero(~hit, neg).alias("tn"))


def best_threshold(scores: DataFrame, low: float = 0.30, high: float = 0.70, step: float = 0.01) -> DataFrame:
    """The least threshold of the highest accuracy."""
    values = grid(scores.sparkSession, np.round(np.arange(low, high + step / 2, step), 2))
    rows = metrics(at_thresholds(scores, values)).select("threshold", "accuracy")
    return rows.agg(F.max_by("threshold", F.struct("accuracy", -F.col("threshold"))).alias("threshold"), F.max("accuracy").alias("accuracy"))


def roc_curve(scores: DataFrame, points: int = 200) -> DataFrame:
    rows = at_thresholds(scores, grid(scores.sparkSession, np.linspace(0, 1, points)))
    return rows.select("threshold", ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"))


def auc(scores: DataFrame) -> DataFrame:
    """The exact rank statistic, ties averaged; 0.5 with one class only. Ranks run over distinct scores, ranged over partitions."""
    rows = positions(by_score(scores), ["p"], "below", "n").withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    sums = rows.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    return sums.select(F.when((F.col("pos") == 0) | (F.col("neg") == 0) | F.col("pos").isNull(), 0.5).otherwise((F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auc"))


def calibration(scores: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean score, share of positives and their gap; the last bin is closed."""
    # Sums such as 0.35 + 0.25 may fall short of an edge by their rounding alone.
    which = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("p") * bins + 1e-12))).cast("int")
    rows = scores.withColumn("bin", which).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("positive_share"))
    return rows.withColumn("gap", F.abs(F.col("mean_score") - F.col("positive_share")))


def probability_losses(scores: DataFrame) -> DataFrame:
    y, p = F.col("y").cast("double"), F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    return scores.agg(F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def calibration_error(scores: DataFrame, bins: int = 10) -> DataFrame:
    """ece: the gaps of the bins, weighted by their rows."""
    rows = calibration(scores, bins)
    return rows.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def resampled(values: DataFrame, repeats: int, seed: int) -> DataFrame:
    """rep, n and mean of ``value`` over resamples of the rows of ``values`` (value, few distinct ones), as many rows in each as there are.

    A resample draws every row anew, each with the same chance, so its counts
    of the distinct values are multinomial; they are split off one after the
    other by binomial draws, which add up to the number of rows. A repeat's
    draws hang on its number and the seed, not on partitions.
    """
    import pandas as pd

    counts = sorted((r["value"], r["n"]) for r in values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("value is not null").collect())  # two or three rows
    size = sum(n for _, n in counts)

    def run(batches):
        for batch in batches:
            means = []
            for rep in batch["rep"]:
                draw, left, rows, total = np.random.default_rng([seed, int(rep)]), size, size, 0
                for value, n in counts:
                    times = int(draw.binomial(left, n / rows)) if n < rows else left
                    left, rows, total = left - times, rows - n, total + value * times
                means.append(total / size if size else None)
            yield pd.DataFrame({"rep": batch["rep"], "n": size, "mean": pd.array(means, dtype="Float64")})

    reps = values.sparkSession.range(repeats).withColumnRenamed("id", "rep")
    return reps.mapInPandas(run, "rep long, n long, mean double")


def bootstrap(scores: DataFrame, threshold: float = 0.5, repeats: int = 2000, seed: int = 7) -> DataFrame:
    """Low and high ends of a 95 % interval of accuracy, by resampling rows."""
    right = ((F.col("p") >= threshold) == (F.col("y") == 1)).cast("long")
    return resampled(scores.select(right.alias("value")), repeats, seed).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


def paired_bootstrap(both: DataFrame, threshold: float = 0.5, repeats: int = 2000, seed: int = 7) -> DataFrame:
    """The gain in accuracy of the scores q, cut at ``threshold``, over the scores p, cut at 0.5 (doc_id, y, p, q), and its interval: a row is drawn with both."""
    ok = lambda c, cutoff: ((F.col(c) >= cutoff) == (F.col("y") == 1)).cast("long")
    gains = both.select((ok("q", threshold) - ok("p", 0.5)).alias("value"))
    ends = resampled(gains, repeats, seed).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return gains.agg(F.try_divide(F.sum("value"), F.count("value")).alias("gain")).crossJoin(ends)


def folds(rows: DataFrame, k: int = 5, seed: int = 7) -> DataFrame:
    """``rows`` with a fold: dealt in turn in the order of a hash of doc_id, so sizes are one apart at most and the same on every run."""
    return positions(rows.withColumn("__h", F.xxhash64("doc_id", F.lit(seed))), ["__h", "doc_id"], "__at").withColumn("fold", F.pmod("__at", F.lit(k)).cast("int")).drop("__h", "__at")


def multiclass(scores: DataFrame) -> DataFrame:
    """Counts, precision, recall and f1 of each class from (truth, guess)."""
    cells = scores.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g"), (F.col("truth") == F.col("guess")).cast("int").alias("both")), F.struct(F.col("guess").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("both")))).alias("x")).select("x.*")
    rows = cells.groupBy("label").agg(F.sum("t").alias("support"), F.sum("g").alias("guessed"), F.sum("both").alias("tp"))
    return rows.select("label", "support", "guessed", "tp", ratio(F.col("tp"), F.col("guessed")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("guessed")).alias("f1"))


def weighted(classes: DataFrame) -> DataFrame:
    """precision, recall and f1 of ``multiclass`` rows, weighted by support; 0 without any."""
    total = F.sum("support")
    return classes.agg(*(ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in ("precision", "recall", "f1")), total.alias("support"))


def confusion_shares(scores: DataFrame) -> DataFrame:
    """truth, guess, n, the cell's share of all rows, and its intensity, the share of the largest cell. One row for each cell."""
    cells = scores.groupBy("truth", "guess").agg(F.count(F.lit(1)).alias("n"))
    sums = cells.agg(F.sum("n").alias("__all"), F.max("n").alias("__most"))
    return cells.crossJoin(F.broadcast(sums)).select("truth", "guess", "n", (F.col("n") / F.col("__all")).alias("share"), (F.col("n") / F.col("__most")).alias("intensity"))


def accuracy_by_label(scores: DataFrame) -> DataFrame:
    """label, n and accuracy of rows (truth, guess); labels that no row has are left out."""
    return scores.groupBy(F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("truth") == F.col("guess")).cast("double")).alias("accuracy"))


def label_distribution(rows: DataFrame, labels) -> DataFrame:
    """label and n for each of ``labels``, 0 where no row has it."""
    named = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], f"place int, label {dict(rows.dtypes)['label']}")
    return named.join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").select("place", "label", F.coalesce("n", F.lit(0)).alias("n"))


def majority_baseline(scores: DataFrame) -> DataFrame:
    """baseline: the accuracy of always saying the larger class of (y)."""
    share = F.avg(F.col("y").cast("double"))
    return scores.agg(F.greatest(share, 1 - share).alias("baseline"))


def assessment(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All measures of a set of scores in one row, with the baseline, and whether the interval of accuracy lies above it."""
    rows = metrics(confusion(scores, threshold)).crossJoin(bootstrap(scores, threshold)).crossJoin(auc(scores)).crossJoin(probability_losses(scores)).crossJoin(calibration_error(scores)).crossJoin(majority_baseline(scores))
    return rows.withColumn("beats_baseline", F.col("low") > F.col("baseline")).withColumn("threshold", F.lit(float(threshold)))


def best_values(metrics_by_model: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """metric, best and the models that reach it, for a wide table (model, a column for each metric); a few rows."""
    long = metrics_by_model.select("model", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("model", "x.*")
    most = long.groupBy("metric").agg(F.max("value").alias("best"))
    return most.join(long, "metric").filter("value = best").groupBy("metric", "best").agg(F.array_sort(F.collect_list("model")).alias("models"))


def write_results(rows: DataFrame, path: str) -> None:
    """Evaluation rows as one JSON file; they are few."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_results(spark, path: str) -> DataFrame:
    return spark.read.json(path)


def merge_results(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` rows, those with the model of a ``new`` row replaced by it."""
    return stored.join(new.select("model"), "model", "left_anti").unionByName(new, allowMissingColumns=True)


def stance_sweep(scored: DataFrame, thresholds, dominances) -> DataFrame:
    """Accuracy, precision, recall and invented stances of the stance rule over a grid, for (support, contradiction, label)."""
    from factloom.operators.evidence import document_stance

    spark = scored.sparkSession
    settings = grid(spark, thresholds).crossJoin(grid(spark, dominances, "dominance"))
    said = document_stance(F.col("support"), F.col("contradiction"), F.col("threshold"), F.col("dominance"))
    directed, right = F.col("said") != "unclear", F.col("said") == F.col("label")
    rows = scored.crossJoin(F.broadcast(settings)).withColumn("said", said).groupBy("threshold", "dominance").agg(
        F.count_if(right).alias("right"), F.count_if(directed).alias("directed"), F.count_if(directed & right).alias("hits"),
        F.count_if(F.col("label") != "unclear").alias("wanted"), F.count_if(directed & (F.col("label") == "unclear")).alias("invented"),
    )
    return rows.select("threshold", "dominance", "right", "invented", ratio(F.col("hits"), F.col("directed")).alias("precision"), ratio(F.col("hits"), F.col("wanted")).alias("recall"))


def probability_words(p: Column) -> Column:
    """Five bands."""
    return F.when(p < 0.2, "very likely incorrect").when(p < 0.4, "probably incorrect").when(p < 0.6, "uncertain or mixed").when(p < 0.8, "probably correct").otherwise("very likely correct")
