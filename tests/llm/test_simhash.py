import random

import xxhash

from emberline.llm import simhash

SCHEMA = "doc_id long, text string, fp string, node long"


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows, radius):
    marks = {i: plain_fingerprint(t, 3) for i, t in rows}
    label = {i: i for i in marks}
    changed = True
    while changed:
        changed = False
        for i in marks:
            for j in marks:
                if (marks[i] ^ marks[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (f"{marks[i]:016x}", label[i]) for i in marks}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (6, "ONE two"), (7, "one two three"), (8, "é x é É")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        for c in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(c // 2):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((100 + 20 * g + c, " ".join(own)))
    return rows


def test_digest_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_digest(docs).collect()}
    assert got == brute(rows, 3)
    assert len({c for _, c in got.values()}) < len(rows) - 5


def brute_links(marks, radius):
    label = {i: i for i in marks}
    for i in marks:
        for j in marks:
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return label


def check_links(spark, segments, reach, radius, limit):
    from emberline.operators.components import connected_components

    rng = random.Random(radius)
    marks, n = {}, 0
    for _ in range(20):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 4, 12])):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 2)))
            if base not in marks.values():
                marks[n] = base
                n += 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(i, signed(m), 0) for i, m in marks.items()], "node long, fp long, fp2 long")
    found = {r["node"]: r["component"] for r in connected_components(simhash.links(nodes, radius, segments, reach, limit=limit)).collect()}
    assert {i: found.get(i, i) for i in marks} == brute_links(marks, radius)


def test_radius_three(spark):
    check_links(spark, 2, 1, 3, 1 << 15)


def test_radius_eleven(spark):
    check_links(spark, 4, 2, 11, 1 << 15)


def test_crowded_rows_are_compared_in_blocks(spark):
    check_links(spark, 4, 2, 11, 3)


def test_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check_links(spark, 4, 2, 11, 1 << 15)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_repeated_rows(spark):
    assert simhash.simhash_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(7, "a b c d", None, None)] * 3 + [(None, "a b c d", None, None)], SCHEMA)
    assert [(r["doc_id"], r["component_id"]) for r in simhash.simhash_digest(docs).collect()] == [(7, 7)] * 3
