"""Fitting the scorer: median imputation, standardisation, logistic regression, grouped folds, Platt calibration.

Spark has no stratified grouped folds: folds here are a hash of the group, so they differ from the reference's,
and so do fitted weights in the last digits. Scoring is exact. Data stays in Spark; the driver sees medians, means,
weights and metrics.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.evaluation import rank_metrics, threshold_sweep
from emberline.operators.scoring import Artifact, score
from emberline.session import materialize, release

GRID = [round(0.2 + 0.01 * k, 2) for k in range(61)]


def folds(rows: DataFrame, group: str, k: int = 5) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(k)).cast("int"))


def leaked_groups(rows: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that stand on more than one side of a split: a sound split has none."""
    return rows.groupBy(group).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def fit(rows: DataFrame, features: list[str], label: str, c: float, weight: str | None = None) -> Artifact:
    """An uncalibrated artifact. Constant features are dropped."""
    stats = rows.agg(
        *[F.median(f).alias(f"m_{f}") for f in features],
        F.count(F.lit(1)).alias("n"),
    ).first()
    medians = {f: stats[f"m_{f}"] for f in features if stats[f"m_{f}"] is not None}
    filled = rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(float(m))) for f, m in medians.items()})
    spread = filled.agg(*[x for f in medians for x in (F.avg(f).alias(f"a_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    used = [f for f in medians if spread[f"s_{f}"]]
    mean, scale = [spread[f"a_{f}"] for f in used], [spread[f"s_{f}"] for f in used]
    z = filled.withColumns({f: (F.col(f) - m) / s for f, m, s in zip(used, mean, scale, strict=True)})
    z = VectorAssembler(inputCols=used, outputCol="__x").transform(z).select("__x", F.col(label).cast("double").alias("__y"), (F.col(weight) if weight else F.lit(1.0)).alias("__w"))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=1 / (c * max(1, stats["n"])), standardization=False, maxIter=100).fit(z)
    return Artifact(tuple(used), tuple(float(medians[f]) for f in used), tuple(mean), tuple(scale), tuple(map(float, model.coefficients)), float(model.intercept), 1.0, 0.0, 0.5)


def out_of_fold(rows: DataFrame, features: list[str], label: str, group: str, c: float, k: int) -> DataFrame:
    """label, logit of each row by the model that hasn't seen its group."""
    dealt = folds(rows, group, k)
    parts = None
    for i in range(k):
        scored = score(dealt.where(F.col("fold") == i), fit(dealt.where(F.col("fold") != i), features, label, c)).select(F.col(label).cast("int").alias("y"), "logit")
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def calibrated(rows: DataFrame, features: list[str], label: str, group: str, grid: tuple[float, ...] = (0.03, 0.3), k: int = 3, tolerance: float = 0.005) -> tuple[Artifact, dict[float, float]]:
    """The smallest C whose AUC is within tolerance of the best, with Platt's a and b and the F1 threshold, all out of fold; and the AUC of each C."""
    held = {c: materialize(out_of_fold(rows, features, label, group, c, k), "out-of-fold") for c in grid}  # written: a lost executor refits nothing
    paths = [path for _, path in held.values()]
    held = {c: oof for c, (oof, _) in held.items()}
    auc = {c: rank_metrics(oof, F.col("y"), F.round("logit", 6)).first()["roc_auc"] or 0.0 for c, oof in held.items()}
    c = min(x for x in grid if auc[x] >= max(auc.values()) - tolerance)
    x = VectorAssembler(inputCols=["logit"], outputCol="__x").transform(held[c])
    platt = LogisticRegression(featuresCol="__x", labelCol="y", standardization=False).fit(x)
    a, b = float(platt.coefficients[0]), float(platt.intercept)
    sweep = threshold_sweep(held[c], F.col("y"), 1 / (1 + F.exp(-(a * F.col("logit") + b))), GRID).orderBy(F.col("f1").desc(), "threshold").first()
    for path in paths:
        release(rows.sparkSession, path)
    base = fit(rows, features, label, c)
    return Artifact(base.features, base.median, base.mean, base.scale, base.coef, base.intercept, a, b, float(sweep["threshold"])), auc


def bootstrap_auc_difference(rows: DataFrame, label: str, a: str, b: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """mean, low, high (95 %) of AUC(a) - AUC(b): each replicate is Poisson-resampled by row hashes, in one pass by replicate.

    A row's weight in a replicate is a function of its own hash, so nothing is collected and reruns agree.
    """
    u = lambda salt: F.pmod(F.xxhash64("__h", "rep", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cuts = np.cumsum([np.exp(-1.0) / np.prod(range(1, k + 1) or [1]) for k in range(8)])
    n = sum((F.when(u(seed) > float(x), 1).otherwise(0) for x in cuts), F.lit(0))
    base = rows.select(F.col(label).cast("int").alias("y"), F.round(a, 3).alias("a"), F.round(b, 3).alias("b"), F.xxhash64(*rows.columns).alias("__h"))
    drawn = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).withColumn("n", n).where("n > 0")
    from pyspark.sql import Window

    def auc(s: str) -> DataFrame:
        by = drawn.groupBy("rep", F.col(s).alias("s")).agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
        under = F.coalesce(F.sum("q").over(Window.partitionBy("rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return by.withColumn("u", F.col("p") * (under + F.col("q") / 2)).groupBy("rep").agg((F.sum("u") / (F.sum("p") * F.sum("q"))).alias(f"auc_{s}"))

    diff = auc("a").join(auc("b"), "rep").select((F.col("auc_a") - F.col("auc_b")).alias("d"))
    return diff.agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
