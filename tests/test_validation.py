import numpy as np
import pytest

from emberline.operators import validation
from emberline.plans import catalog_plans

SF = "/root/testdata/sf0.001"
GRID = (0.01, 0.1, 1.0)


def test_nested_cv_equals_plain_loops(spark):
    rows = catalog_plans.labelled(spark, SF)
    got = {r["id"]: r for r in validation.nested_cv(rows, "id", catalog_plans.FEATURES, "label", "grp", GRID).collect()}
    again = {r["id"]: r for r in validation.nested_cv(rows.repartition(3), "id", catalog_plans.FEATURES, "label", "grp", GRID).collect()}
    keyed = sorted(validation._keyed(rows, "id", catalog_plans.FEATURES, "label", "grp", 5, 3, 0).collect(), key=lambda r: r["id"])
    assert got == again and set(got) == {r["id"] for r in keyed}
    x, y, fold = np.array([r["x"] for r in keyed], float), np.array([r["y"] for r in keyed]), np.array([r["fold"] for r in keyed])
    assert len({(r["grp"], r["fold"]) for r in keyed}) == len({r["grp"] for r in keyed})  # no group on two sides
    for o in range(5):
        out = fold != o
        own = np.array([r["inner"][o] for r in keyed])
        means = []
        for c in GRID:
            each = []
            for i in range(3):
                train, test = out & (own != i), out & (own == i)
                said = validation.trained_scores(x[train], y[train], x[test], c) >= 0.5
                each.append(np.mean([np.mean(said[y[test] == k] == k) for k in (0, 1) if (y[test] == k).any()]))
            means.append(round(float(np.mean(each)), 12))
        best = GRID[int(np.argmax(means))]
        want = validation.trained_scores(x[out], y[out], x[~out], best)
        for r, p in zip([r for r in keyed if r["fold"] == o], want, strict=True):
            assert got[r["id"]]["best_c"] == best and got[r["id"]]["probability"] == pytest.approx(p, abs=1e-9)


def test_newton_finds_the_minimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.0] + rng.normal(size=200) > 0.7).astype(int)
    w, b = validation.fit_logistic(x, y, 0.3)

    def loss(w, b):
        weight = np.where(y == 1, 100 / (y == 1).sum(), 100 / (y == 0).sum())
        margin = (x @ w + b) * (2 * y - 1)
        return 0.3 * (weight * np.log1p(np.exp(-margin))).sum() + (w @ w + b * b) / 2

    assert all(loss(w, b) <= loss(w + d[:3], b + d[3]) for d in 1e-3 * rng.normal(size=(50, 4)))


def test_one_class_and_too_many_rows(spark):
    rows = spark.createDataFrame([(k, float(k), 1, f"g{k % 7}") for k in range(30)], "id long, a double, label int, grp string")
    assert {r["probability"] for r in validation.nested_cv(rows, "id", ["a"], "label", "grp").collect()} == {0.5}
    with pytest.raises(ValueError, match="takes 10 at most"):
        validation.nested_cv(rows, "id", ["a"], "label", "grp", most=10)


def test_quotas_take_whole_groups_once(spark):
    rows = spark.createDataFrame([(k, f"g{k % 12}" if k % 5 else "", "ab"[k % 2]) for k in range(100)], "id long, grp string, kind string")
    held = validation.group_holdout(rows, "id", "grp", "kind", {"a": 4, "b": 5}, 3)
    got = held.collect()
    assert [r["kind"] for r in got] == ["a"] * 4 + ["b"] * 5 and len({r["grp"] for r in got}) == 9 and "" not in {r["grp"] for r in got}
    assert sorted(got) == sorted(validation.group_holdout(rows.repartition(4), "id", "grp", "kind", {"a": 4, "b": 5}, 3).collect())
    left = validation.without_groups(rows, "grp", held)
    assert not {r["grp"] for r in left.collect()} & {r["grp"] for r in got} and left.where("grp = ''").count() == 20
    with pytest.raises(ValueError, match="b needs 7"):
        validation.group_holdout(rows, "id", "grp", "kind", {"a": 4, "b": 7}, 3)
