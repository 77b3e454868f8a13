"""The calibrated logistic scorer, its explanations, and the decision that follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.stats import sigmoid


@dataclass(frozen=True)
class Artifact:
    """Equal-length tuples by feature, and the calibration. Driver-side constants, literals in the plan."""

    features: tuple[str, ...]
    median: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float
    a: float = 1.0
    b: float = 0.0
    threshold: float = 0.42
    confident: float = 0.75

    def __post_init__(self):
        if len({len(x) for x in (self.features, self.median, self.mean, self.scale, self.coef)}) != 1:
            raise ValueError("the artifact's lists differ in length")


def contributions(model: Artifact) -> list[tuple[str, Column]]:
    """Each feature's part of the logit: missing values take the median."""
    out = []
    for k, name in enumerate(model.features):
        value = F.coalesce(F.col(name).cast("double"), F.lit(model.median[k]))
        out.append((name, model.a * model.coef[k] * (value - model.mean[k]) / model.scale[k]))
    return out


def score(rows: DataFrame, model: Artifact, top: int = 5) -> DataFrame:
    """Adds logit, probability, is_signal, confident, top_for, top_against, waterfall (baseline first)."""
    parts = contributions(model)
    base = model.a * model.intercept + model.b
    logit = F.lit(base)
    for _, p in parts:
        logit = logit + p
    listed = F.array(*[F.struct(F.round(p, 4).alias("contribution"), F.lit(n).alias("feature"), F.col(n).isNull().alias("imputed")) for n, p in parts])
    by_size = F.array_sort(listed, lambda x, y: F.when(F.abs(x["contribution"]) > F.abs(y["contribution"]), -1).when(F.abs(x["contribution"]) < F.abs(y["contribution"]), 1).when(x["feature"] < y["feature"], -1).otherwise(1))
    out = rows.withColumn("logit", logit).withColumn("__parts", by_size).withColumn("probability", sigmoid(F.col("logit")))
    out = out.withColumn("is_signal", F.col("probability") >= model.threshold).withColumn("confident", F.col("probability") > model.confident)
    out = out.withColumn("top_for", F.slice(F.filter("__parts", lambda x: x["contribution"] > 0), 1, top)).withColumn("top_against", F.slice(F.filter("__parts", lambda x: x["contribution"] < 0), 1, top))
    return out.withColumn("waterfall", F.concat(F.array(F.struct(F.round(F.lit(base), 4).alias("contribution"), F.lit("baseline").alias("feature"), F.lit(False).alias("imputed"))), "__parts")).drop("__parts")


def exclusion_reasons() -> Column:
    """Why a row looks like a mature technology, noise or no technology: an array of short names."""
    c = F.col
    rules = (
        ("scaling_or_mature", c("stage_scaling_or_mature") == 1), ("mass_market", c("mass_market_flag") == 1), ("not_a_technology", c("is_technology_flag") == 0),
        ("final_standard", c("final_standard_flag") == 1), ("old_and_not_growing", (c("first_evidence_age_years") >= 15) & (c("paper_growth_2y") <= 0)),
        ("no_science_or_media", (c("missing_science") == 1) & (c("missing_media") == 1)), ("mostly_unverifiable", c("unverifiable_source_share") >= 0.7),
    )
    return F.filter(F.array(*[F.when(ok, name) for name, ok in rules]), lambda x: x.isNotNull())


MATURE_REASONS = ("scaling_or_mature", "mass_market", "final_standard", "old_and_not_growing")


def decide(judged: Column, scored: Column, is_signal: Column, reasons: Column, grounded: Column, supported: Column) -> Column:
    """The verdict: an unscored or imputed row never becomes a signal; irrelevant stays; then threshold, quotes, sources."""
    mature = F.arrays_overlap(reasons, F.array(*map(F.lit, MATURE_REASONS)))
    return (
        F.when(~scored, F.when(judged == "weak_signal", "insufficient_evidence").otherwise(judged))
        .when(judged == "irrelevant", judged)
        .when(~is_signal, F.when(mature, "mature").otherwise("hype_or_noise"))
        .when(~grounded, "insufficient_evidence")
        .when(~supported, "insufficient_evidence")
        .otherwise("weak_signal")
    )


# The rubric's weights and values.
WEIGHTS = {"early_stage": 30, "novelty": 25, "momentum": 20, "evidence": 25}
VALUES = {"strong": 1.0, "partial": 0.5, "unknown": 0.0, "contradictory": 0.0}


def rubric_score(values: dict[str, Column]) -> Column:
    """Sum of weights times values, halves to even."""
    total = F.lit(0.0)
    for name, w in WEIGHTS.items():
        worth = F.lit(0.0)
        for v, x in VALUES.items():
            worth = F.when(values[name] == v, F.lit(x)).otherwise(worth)
        total = total + w * worth
    return F.bround(total, 0).cast("int")
