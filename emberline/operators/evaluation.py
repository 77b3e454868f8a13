"""Agreement and classifier metrics as aggregations.

Scores are grouped by value before anything is ordered, so rank statistics run over distinct scores in one window;
round scores first where there are very many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cohens_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed, expected, kappa. Pairs with a null don't count; no pairs: NULLs."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy("a").agg(F.sum("n").alias("na"))
    right = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    rows = total.crossJoin(chance)  # one row each
    observed, expected = F.col("same") / F.col("total"), F.col("chance") / (F.col("total") * F.col("total"))
    kappa = F.when(expected == 1, F.when(observed == 1, 1.0).otherwise(0.0)).otherwise((observed - expected) / (1 - expected))
    return rows.select(F.col("total").alias("n"), F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(kappa, 6).alias("kappa"))


def weighted_kappa(pairs: DataFrame, a: str, b: str, categories: list[int]) -> DataFrame:
    """One row: kappa with quadratic weights over categories in order; NULL where chance alone explains nothing."""
    index = lambda c: F.array_position(F.array(*map(F.lit, categories)), F.col(c)) - 1
    cells = pairs.select(index(a).alias("i"), index(b).alias("j")).where("i >= 0 and j >= 0").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    top = max(1, (len(categories) - 1) ** 2)
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("i") - F.col("j"), 2)).alias("d"))
    rows, cols = cells.groupBy("i").agg(F.sum("n").alias("ni")), cells.groupBy("j").agg(F.sum("n").alias("nj"))
    by_chance = rows.crossJoin(F.broadcast(cols)).agg(F.sum(F.col("ni") * F.col("nj") * F.pow(F.col("i") - F.col("j"), 2)).alias("e"))  # categories by categories
    out = total.crossJoin(by_chance)
    observed, expected = F.col("d") / (F.col("n") * top), F.col("e") / (F.col("n") * F.col("n") * top)
    return out.select(F.round(F.when(expected > 0, 1 - observed / expected), 6).alias("weighted_kappa"))


def confusion(rows: DataFrame, label: Column, score: Column, threshold: float) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, specificity, balanced_accuracy, brier. Empty denominators give 0."""
    y, p = label.cast("int"), score >= threshold
    n = rows.where(label.isNotNull() & score.isNotNull()).agg(
        F.count_if((y == 1) & p).alias("tp"), F.count_if((y == 0) & p).alias("fp"), F.count_if((y == 1) & ~p).alias("fn"), F.count_if((y == 0) & ~p).alias("tn"), F.round(F.avg(F.pow(score - y, 2)), 6).alias("brier")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return n.select(
        "tp", "fp", "fn", "tn", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
        F.round(specificity, 6).alias("specificity"), F.round((recall + specificity) / 2, 6).alias("balanced_accuracy"), "brier",
    )


def _by_score(rows: DataFrame, label: Column, score: Column) -> DataFrame:
    return rows.where(label.isNotNull() & score.isNotNull()).groupBy(score.alias("s")).agg(F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg"))


def rank_metrics(rows: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row: roc_auc (ties count half) and average_precision; NULL where one class is missing."""
    order = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    by = _by_score(rows, label, score).select(
        "*", F.coalesce(F.sum("neg").over(order), F.lit(0)).alias("under"), F.sum("pos").over(down).alias("tp"), F.sum(F.col("pos") + F.col("neg")).over(down).alias("n")
    )
    out = by.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("u"), F.sum(F.col("pos") * F.col("tp") / F.col("n")).alias("ap"))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return out.select(F.round(F.when(both, F.col("u") / (F.col("p") * F.col("q"))), 6).alias("roc_auc"), F.round(F.when(both, F.col("ap") / F.col("p")), 6).alias("average_precision"))


def threshold_sweep(rows: DataFrame, label: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """threshold, precision, recall, f1 on a grid; rows are counted by the last threshold they pass before the grid meets them."""
    grid = F.array(*map(F.lit, thresholds))
    passed = F.size(F.filter(grid, lambda t: score >= t))
    counts = rows.where(label.isNotNull() & score.isNotNull()).groupBy(passed.alias("k")).agg(F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg"))
    steps = rows.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)], "i int, threshold double")
    out = steps.crossJoin(F.broadcast(counts)).groupBy("threshold").agg(  # grid by grid
        F.sum(F.when(F.col("k") >= F.col("i"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") >= F.col("i"), F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("p")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select("threshold", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("p")), 6).alias("recall"), F.round(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), 6).alias("f1"))
