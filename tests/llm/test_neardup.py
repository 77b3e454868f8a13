import random

from emberline.llm import neardup

SCHEMA = "doc_id long, text string, fp string, node long"


def shingle_set(text):
    own = (text or "").encode().lower().split()
    return {b" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))}


def at_least(a, b, t=0.8):
    both = len(a & b)
    return both >= t * (len(a) + len(b) - both) - 1e-9


def brute_similar(rows):
    """Components by the Jaccard similarity of every two sets."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i != j and at_least(a, b):
                x, y = label[i], label[j]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return label


def edited(rng, base, n, block):
    own = list(base)
    at = rng.randrange(len(own) - n + 1)
    for k in range(at, at + n) if block else rng.sample(range(len(own)), n):
        own[k] = f"x{rng.randrange(10**9)}"
    return " ".join(own)


def similar_corpus():
    rng = random.Random(17)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one three"), (None, "one two")]
    near = 0
    for g in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 100, 300, 1000]))]
        rows.append((1000 + 10 * g, " ".join(base)))
        for c in range(1, 3):  # scattered words, or one passage, changed up to similarities of about 0.75 to 0.9
            block = c == 2
            most = len(base) * (0.14 if block else 0.027)
            rows.append((1000 + 10 * g + c, edited(rng, base, max(1, round(most * rng.uniform(0.4, 1))), block)))
            a, b = shingle_set(rows[-1][1]), shingle_set(" ".join(base))
            near += 0.8 <= len(a & b) / len(a | b) <= 0.85
    assert near >= 20
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(3000 + k, passage + " " + " ".join(f"q{k}x{j}" for j in range(30))) for k in range(40)]  # two thirds in common: no near copies
    many = [f"v{k}" for k in range(200)]
    rows += [(4000 + k, edited(rng, many, 1 + k % 5, True)) for k in range(40)]
    return rows


def test_similar_components_against_brute_force(spark):
    rows = similar_corpus()
    want = brute_similar(rows)
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t in [*rows, rows[30]]], SCHEMA).repartition(4)
    for limit in (1 << 15, 8):
        got = neardup.similar_components(docs, limit=limit).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(want)
    kept = sorted(r["doc_id"] or -1 for r in neardup.keep_one_of_each(docs).collect())
    assert kept == sorted([-1, *(i for i, c in want.items() if i == c)] + [rows[30][0]] * (want[rows[30][0]] == rows[30][0]))


def test_texts_of_one_id_are_one_node(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(50)) for x in "ab")
    docs = spark.createDataFrame([(7, a, None, None), (7, b, None, None), (8, a + " end", None, None), (9, b + " end", None, None), (10, b, None, None)], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in neardup.similar_components(docs).collect()} == {7: 7, 8: 7, 9: 7, 10: 7}
    assert neardup.similar_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_of_each(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    near = list(base)
    near[7] = near[150] = "changed"
    other = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    docs = spark.createDataFrame([(5, " ".join(base), "x", 1), (3, " ".join(near), "x", 1), (9, " ".join(base), "x", 1), (2, " ".join(other), None, None)], SCHEMA)
    kept = neardup.keep_one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3] and kept.columns == docs.columns


def test_a_crowd_in_blocks_equals_brute_force(spark):
    """Pages of one template, most of them below the limit to each other, cut into blocks of 32."""
    rng = random.Random(23)
    base = [f"t{k}" for k in range(120)]
    rows = [(k, edited(rng, base, rng.randrange(2, 22), True)) for k in range(150)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.similar_components(docs, limit=40).collect()}
    assert got == brute_similar(rows) and 1 < len(set(got.values())) < 150
