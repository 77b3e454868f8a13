import os
import random
import re
from collections import Counter

import pytest

from emberline.llm import decontam
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, start int, similarity string"
ITEMS = "item_id long, text string, doc_id string"


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def bag(w, width):
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(docs, items, limit=0.8):
    out = {}
    for i, t in docs:
        dw = words(t)
        for j, b in items:
            iw = words(b)
            if not iw or not dw or i is None:
                continue
            width, best = min(5, len(iw)), None
            own = bag(iw, width)
            for s in range(max(0, len(dw) - len(iw)) + 1):
                win = bag(dw[s : s + len(iw)], width)
                both = sum((own & win).values())
                sim = both / (sum(own.values()) + sum(win.values()) - both)
                if best is None or sim > best[0]:
                    best = (sim, s)
            if best[0] >= limit:
                out[i, j] = (round(best[0], 9), best[1])
    return out


def corpus(seed=6):
    rng = random.Random(seed)
    vocab = [f"wort{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randrange(14, 60)))) for k in range(15)]
    items += [(50, "x y x y x y x y x y x y x y"), (51, "Zwei Wörter"), (52, None), (53, ""), (None, "x"), (54, items[3][1])]
    docs = [(1, None), (2, ""), (3, "zwei, WÖRTER!"), (4, "x y " * 40), (5, items[2][1]), (6, items[2][1][: len(items[2][1]) * 9 // 10])]
    for i in range(80):
        own = rng.choices(vocab, k=rng.randrange(0, 200))
        if i % 2:
            leak = words(items[i % 15][1])
            for _ in range(i // 10 % 4):
                k = rng.choice([0, 1, len(leak) - 1, rng.randrange(len(leak))])
                if rng.random() < 0.5:
                    leak[k] = "other"
                else:
                    leak.insert(k, "more")
            at = rng.randrange(len(own) + 1)
            own[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in leak]
        docs.append((100 + i, " ".join(own)))
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, small):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in docs] + [(None, items[1][1], 1, "x"), (105, docs[11][1], 7, "again")], DOCS).repartition(4)
    bench = spark.createDataFrame([(j, b, "clash") for j, b in items], ITEMS)
    sizes = {"seeds_per_block": 60, "few_docs": 0} if small else {}
    out = decontam.contaminated(df, bench, **sizes).collect()
    want = brute(docs, [x for x in items if x[0] is not None])
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["window_start"]) for r in out}
    assert set(got) == set(want) and len(out) == len(got)
    assert all(got[k][0] == want[k][0] for k in want)
    assert len([k for k in want if want[k][0] < 1]) >= 5


def test_index_radius_is_guaranteed(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(63)
        rows.append((a, a ^ sum(1 << b for b in rng.sample(range(63), 19))))
    own = spark.createDataFrame([(50 + k % 2, k, a) for k, (a, _) in enumerate(rows)], "n_words int, item_key long, item_fp long")
    windows = spark.createDataFrame([(50 + k % 2, b) for k, (_, b) in enumerate(rows)], "n_words int, fp long")
    for index_rows in (1 << 20, 1 << 17):
        got = {(r["fp"], r["item_key"]) for r in decontam.near_items(windows, own, 19, index_rows).collect()}
        close = {(b, k) for w, (_, b) in enumerate(rows) for k, (a, _) in enumerate(rows) if w % 2 == k % 2 and (a ^ b).bit_count() <= 19}
        assert got == close and len(got) >= 300


def test_recall_at_the_limit(spark):
    """Windows at 0.80 to 0.85 of an item, one item a document: the index may lose one in a hundred at most."""
    rng = random.Random(31)
    items, docs = [], []
    for k in range(400):
        own = [f"k{k}w{j}" for j in range(rng.randrange(30, 120))]
        n = len(own) - 4
        gone = rng.randrange(0, n + 1 - (n - int(n / 9)))  # of n shingles g are others': similarity (n - g) / (n + g)
        edited = own[:]
        edited[0 : max(1, gone)] = [f"x{rng.random()}" for _ in range(max(1, gone))]
        bag = lambda words: Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        a, b = bag(own), bag(edited)
        if 0.8 <= (a & b).total() / (a | b).total() <= 0.85:
            items.append((k, " ".join(own)))
            docs.append((k, " ".join([f"before{k}"] * 7 + edited + [f"after{k}"] * 9)))
    assert len(docs) >= 40
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} <= {(k, k) for k, _ in docs} and len({r["doc_id"] for r in found}) >= 0.99 * len(docs)



def test_simhash_bits(spark):
    hashes = [-1, 5, 7, -(2**63), 123456789, 2**40]
    got = spark.createDataFrame([(hashes,)], "h array<long>").select(decontam.simhash("h").alias("f")).first()["f"]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert got & (2**64 - 1) == want


def test_empty_tables_and_filter(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 7, "c") for i, t in docs], DOCS)
    bench = spark.createDataFrame([(j, b, "c") for j, b in items], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    assert decontam.contaminated(df, none).count() == 0
    assert decontam.contaminated(spark.createDataFrame([], DOCS), bench).count() == 0
    kept = decontam.drop_contaminated(df, bench)
    bad = {i for i, _ in brute(docs, [x for x in items if x[0] is not None])}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - bad


def test_parts_in_another_order_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda k: [f"u{rng.randrange(10**6)}" for _ in range(k)]
    items, docs = [], []
    for k, n in enumerate([64, 48, 80, 56]):
        own = word(n)
        items.append((k, " ".join(own)))
        turned = n // 3
        docs.append((10 * k, " ".join(word(50) + own[n // 2 :] + own[: n // 2] + word(70))))  # halves swapped
        docs.append((10 * k + 1, " ".join(word(30) + own[turned:] + own[:turned] + word(20))))  # turned round
        docs.append((10 * k + 2, " ".join(own[n - turned :] + own[: n - turned])))  # the whole document
    said = word(7)
    items.append((90, " ".join(said + word(30) + said)))  # repeated shingles
    own = words(items[-1][1])
    docs.append((91, " ".join(word(40) + ["other"] * 3 + own[3:] + word(40))))
    docs.append((92, " ".join(word(200) + own[7:] + word(40))))
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(j, b, "clash") for j, b in items], ITEMS)
    want = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["window_start"]) for r in decontam.contaminated(df, bench).collect()}
    assert got == want and {(10 * k, k) for k in range(4)} | {(10 * k + 1, k) for k in range(4)} <= set(want)
    assert {r["doc_id"] for r in decontam.drop_contaminated(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_similarity_of_bags(spark):
    rng = random.Random(4)
    rows = [([rng.randrange(6) for _ in range(rng.randrange(1, 30))], [rng.randrange(6) for _ in range(rng.randrange(1, 30))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", decontam.weighted_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        a, b = Counter(r["a"]), Counter(r["b"])
        assert abs(r["s"] - sum((a & b).values()) / sum((a | b).values())) < 1e-12


def test_wide_counters(spark):
    rng = random.Random(3)
    hashes = [rng.getrandbits(64) - 2**63 for _ in range(500)]
    df = spark.createDataFrame([(hashes,)], "h array<long>")
    r = df.select(decontam.simhash("h").alias("a"), decontam.simhash("h", 32).alias("b")).first()
    assert r["a"] == r["b"]


@pytest.mark.skipif("EMBERLINE_LONG" not in os.environ, reason="takes minutes")
def test_long_items(spark):
    """Items of 5,000 and 70,000 words, the longer beyond what 16-bit counters hold."""
    rng = random.Random(21)
    word = lambda k: [f"l{rng.randrange(10**7)}" for _ in range(k)]
    long, longer = word(5_000), word(70_000)
    changed = list(long)
    for k in range(0, 5_000, 60):
        changed[k] = "other"
    docs = [(1, word(60) + changed + word(40)), (2, word(20) + longer[:66_000] + word(4_000)), (3, word(5_050)), (4, word(30) + long[:1_500] + word(3_500))]
    df = spark.createDataFrame([(i, " ".join(w), 7, "clash") for i, w in docs], DOCS).repartition(4)
    bench = spark.createDataFrame([(1, " ".join(long), "c"), (2, " ".join(longer), "c")], ITEMS)
    got = {(r["doc_id"], r["item_id"]): (r["window_start"], r["similarity"]) for r in decontam.contaminated(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 2)} and got[1, 1][0] == 60
    item, window = bag(long, 5), bag(docs[0][1][60:5_060], 5)
    both = sum((item & window).values())
    assert abs(got[1, 1][1] - both / (sum(item.values()) + sum(window.values()) - both)) < 1e-12 and got[2, 2][1] > 0.8


def test_a_phrase_of_all_items_is_no_seed(spark):
    """Items that share a phrase are sought by what is their own: a document of the phrase alone asks for no window."""
    rng = random.Random(5)
    phrase = "which of the following statements about the text above is true"
    items = [(k, phrase + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(40))) for k in range(30)]
    docs = [(k, f"intro {k} {phrase} outro") for k in range(50)] + [(99, "start " + items[7][1] + " end")]
    df = spark.createDataFrame([(i, t, 7, "c") for i, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], ITEMS)
    got = decontam.contaminated(df, bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(99, 7)]
