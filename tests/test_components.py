import random

from emberline.operators.components import connected_components


def brute(edges):
    label = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_chain_star_and_random(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges += [(5, 5), (None, 3), (3, None), (-7, 39), (1, 0), (1, 0)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
