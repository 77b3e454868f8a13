import math

import numpy as np
import pytest

from emberline.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, part string, q int"


def brute(rows):
    first = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = math.fmod(label + 1, 10) if i % 7 == 0 else label
        new = (int(label), tuple(math.floor(256 * v) for v in x))
        first[i] = min(first.get(i, new), new)
    out = []
    for a, (label, q) in first.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(q, r, strict=True)) for i, (_, r) in first.items() if i != a and len(r) == len(q)}
        best = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:5]
        for p in best([i for i in score if first[i][0] == label]):
            found = best([i for i in score if first[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]])
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **how):
    docs = spark.createDataFrame([(i, label, x, "clash", 1) for i, label, x in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.hard_negatives(docs, **how).collect())


def clustered(n, d, seed, spread=0.3, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    label = rng.integers(0, labels, n)
    x = centres[label] + spread * rng.normal(size=(n, d))
    return [(i, int(label[i]), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize(("spread", "how"), [(0.05, {}), (1.5, {}), (1.5, {"group": 3, "part_bytes": 1 << 10})])
def test_equals_all_pairs(spark, spread, how):
    rows = clustered(900, 6, 3, spread)
    got = mined(spark, rows, **how)
    assert got and got == brute(rows)


def test_ties_repeats_nulls_and_sizes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(-350, 350)]
    rows += rows[:50] + [(100, 2, [1.0, 1.0, 1.0, 1.0]), (1000, 1, [1.0, 2.0]), (1001, 1, [1.0, 2.0]), (1002, 2, [1.0, 1.7]), (1100, 1, [])]
    rows += [(None, 1, [1.0] * 4), (701, None, [1.0] * 4), (702, 1, None), (703, 1, [1.0, None, 1.0, 1.0]), (704, 1, [float("nan"), 1.0, 1.0, 1.0]), (705, 1, [float("inf"), 1.0, 1.0, 1.0])]
    got = mined(spark, rows)
    assert got and got == brute(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 3), (rng.integers(1, 1 << 20, 3).astype(float) * 4 + 0.5).tolist()) for i in range(0, 400, 4)]
    assert mined(spark, rows) == brute(rows)
    wide = [(0, 1, [1e18]), (1, 1, [1e6]), (100, 1, [1e6]), (2, 0, [0.9e6]), (3, 0, [1e300]), (200, 0, [-1e300])]
    assert mined(spark, wide) == [(100, 1, 1, 2, 256_000_000**2, 256_000_000 * 230_400_000)]


def test_empty_table_and_no_partners(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []


def test_node_pairs_are_pruned(spark):
    """Interval bounds hold, and well separated groups are dropped whole."""
    rows = clustered(2000, 8, 9, 0.05, 8)
    x = np.floor(256 * np.array([r[2] for r in rows]))
    ids, label = np.arange(len(rows)), np.array([r[1] for r in rows])
    a, b = negatives.Tree.of(x[:300], ids[:300], label[:300], 16), negatives.Tree.of(x[300:], ids[300:], label[300:], 16)
    i, j = (m.ravel() for m in np.meshgrid(np.arange(len(a.start)), np.arange(len(b.start))))
    low, high = negatives.intervals(a, i, b, j)
    for k in range(0, len(i), 97):
        s = a.x[a.start[i[k]] : a.end[i[k]]] @ b.x[b.start[j[k]] : b.end[j[k]]].T
        assert low[k] <= s.min() and s.max() <= high[k]
    tried = []
    search = negatives.Search(a, True, 5, [[None]] * 300, 80)
    leaf = search.leaf
    search.leaf = lambda *at: (tried.append(1), leaf(*at))
    search.run(b)
    assert len(tried) < 0.35 * (a.left < 0).sum() * (b.left < 0).sum()
