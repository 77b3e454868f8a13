"""Validation that keeps groups apart: nested cross-validation, and holdouts with quotas of whole groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import materialize


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L2 penalty of 1 / c on both and classes weighted alike, by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = z.T @ (weight * (p - y)) * c + w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z * c + np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w[:-1], float(w[-1])


def trained_scores(train: np.ndarray, y: np.ndarray, test: np.ndarray, c: float) -> np.ndarray:
    """Probabilities of test rows: medians for what is missing (0 where nothing is there), constant columns out, standardised, fitted on train alone."""
    with np.errstate(all="ignore"):
        known = ~np.isnan(train).all(0)
        median = np.where(known, np.nanmedian(np.where(known, train, 0), axis=0), 0.0)
    train, test = (np.where(np.isnan(a), median, a) for a in (train, test))
    mean, scale = train.mean(0), train.std(0)
    used = scale > 0
    w, b = fit_logistic((train[:, used] - mean[used]) / scale[used], y, c)
    return 1 / (1 + np.exp(-np.clip((test[:, used] - mean[used]) / scale[used] @ w + b, -500, 500)))


def _keyed(rows: DataFrame, id_: str, features: list[str], label: str, group: str, outer: int, inner: int, seed: int) -> DataFrame:
    """id, y, x, fold, inner (a fold for each outer fold); rows of a group have the same folds."""
    fold = lambda k, *salt: F.pmod(F.xxhash64(F.col(group), *map(F.lit, (seed, *salt))), F.lit(k)).cast("int")
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features))
    return rows.select(F.col(id_).alias("id"), F.col(label).cast("int").alias("y"), x.alias("x"), F.col(group).alias("grp"), fold(outer).alias("fold"), F.array(*(fold(inner, k + 1) for k in range(outer))).alias("inner"))


def nested_cv(
    rows: DataFrame, id_: str, features: list[str], label: str, group: str, grid: tuple[float, ...] = (0.01, 0.03, 0.1, 0.3, 1.0), outer: int = 5, inner: int = 3, seed: int = 0, most: int = 50_000
) -> DataFrame:
    """id, y, grp, fold, best_c, probability: each row scored by a model that has seen no row of its group, nor has the choice of its c.

    Inside each outer fold's training rows every c is tried over inner folds, by balanced accuracy at 0.5, of equal ones the
    first of the grid; then a model with the best is fitted on all of them. All fits are one dimension of the data: rows are
    repeated for each (outer fold, inner fold, c) that needs them, and each fit is one group of one job. Folds are hashes of
    groups, so reruns agree. A fit sees its training rows whole, so the table of labels is bounded: over `most` rows are an
    error, and training.out_of_fold(), which fits in Spark, is the way beyond.
    """
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} labelled rows: nested_cv fits each model in one task and takes {most} at most")
    keyed, _ = materialize(_keyed(rows, id_, features, label, group, outer, inner, seed), "labelled-rows")
    id_type = dict(keyed.dtypes)["id"]
    folds = F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("o")
    tried = keyed.select("*", folds).where("fold <> o").select("id", "y", "x", "o", F.get("inner", F.col("o")).alias("own"))
    tried = tried.select("*", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))).alias("i")).select("*", F.explode(F.array(*map(F.lit, grid))).alias("c"))

    def scored(batch: pd.DataFrame, test: np.ndarray) -> np.ndarray:
        batch_x, y = np.array(batch["x"].tolist(), float), batch["y"].to_numpy()
        if len(set(y[~test].tolist())) < 2:  # nothing to learn from one class: the middle
            return np.full(int(test.sum()), 0.5)
        return trained_scores(batch_x[~test], y[~test], batch_x[test], float(batch["c"].iloc[0]))

    def try_one(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("id", kind="stable")
        test = (batch["own"] == batch["i"]).to_numpy()
        said = scored(batch, test) >= 0.5
        y = batch["y"].to_numpy()[test]
        shares = [float((said == y)[y == k].mean()) for k in (0, 1) if (y == k).any()]
        accuracy = sum(shares) / len(shares) if shares else float("nan")
        return pd.DataFrame({"o": [int(batch["o"].iloc[0])], "i": [int(batch["i"].iloc[0])], "c": [float(batch["c"].iloc[0])], "accuracy": [accuracy]})

    results = tried.groupBy("o", "i", "c").applyInPandas(try_one, "o int, i int, c double, accuracy double")
    means = results.where(~F.isnan("accuracy")).groupBy("o", "c").agg(F.round(F.avg("accuracy"), 12).alias("mean"))
    place = F.array_position(F.array(*map(F.lit, grid)), F.col("c"))
    best = means.groupBy("o").agg(F.max_by("c", F.struct("mean", -place)).alias("c"))
    given = keyed.select("id", "y", "x", "grp", "fold", folds).join(F.broadcast(best), "o")  # a row for each outer fold

    def score_one(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("id", kind="stable")
        test = (batch["fold"] == batch["o"]).to_numpy()
        out = batch.loc[test, ["id", "y", "grp", "fold"]]
        return out.assign(best_c=batch["c"].iloc[0], probability=scored(batch, test) if test.any() else np.zeros(0))[["id", "y", "grp", "fold", "best_c", "probability"]]

    kinds = dict(keyed.dtypes)
    return given.groupBy("o").applyInPandas(score_one, f"id {id_type}, y int, grp {kinds['grp']}, fold int, best_c double, probability double")


def group_holdout(rows: DataFrame, id_: str, group: str, kind: str, quotas: dict[str, int], seed: int = 0) -> DataFrame:
    """The rows held out: of each kind, in the order given, so many rows of groups of their own, by hashes of seed and id.

    A group is taken once: by its first row in hash order, and not again by a later kind. Rows without a group are never taken.
    A kind that has too few groups left is an error. Everything else of the groups taken must leave the training rows:
    without_groups(). What is collected is one row a quota.
    """
    spark = rows.sparkSession
    key = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id_).cast("string")), 256)
    named = rows.where(F.coalesce(F.col(group).cast("string"), F.lit("")) != "").select(F.col(id_).alias("id"), F.col(group).cast("string").alias("grp"), F.col(kind).alias("kind"), key.alias("h"))
    taken: list[tuple] = []
    for name, quota in quotas.items():
        free = named.where(F.col("kind") == name)
        if taken:
            free = free.join(F.broadcast(spark.createDataFrame([(t[1],) for t in taken], "grp string")), "grp", "left_anti")
        first = free.groupBy("grp").agg(F.min(F.struct("h", "id")).alias("r")).orderBy("r").limit(quota).collect()
        if len(first) < quota:
            raise ValueError(f"{name} needs {quota} groups of its own, there are {len(first)}")
        taken += [(r["r"]["id"], r["grp"], name) for r in first]
    id_type = dict(named.dtypes)["id"]
    return spark.createDataFrame(taken, f"id {id_type}, grp string, kind string")


def without_groups(rows: DataFrame, group: str, held: DataFrame) -> DataFrame:
    """Rows (all their columns) of groups that no held-out row belongs to. Rows without a group stay."""
    taken = held.select(F.col("grp").alias("taken_group")).distinct()
    return rows.join(F.broadcast(taken), rows[group].cast("string") == taken["taken_group"], "left_anti")

