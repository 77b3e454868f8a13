import hashlib
import random

import numpy as np

from emberline.llm import fingerprints as fp
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, fingerprint string, n_chars string"


def edits(rows):
    """Edited text and next text by doc_id."""
    order = sorted(rows, reverse=True)
    texts = {i: rows[i] or "" for i in rows}
    out = {}
    for k, i in enumerate(order):
        nxt = texts[order[(k + 1) % len(order)]]
        t = texts[i]
        out[i] = (t[: len(t) - len(t) // 3] + nxt[: len(t) // 3], nxt)
    return out


def jaccard(a, b):
    def parts(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = parts(a), parts(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_digest(spark):
    rng = random.Random(4)
    words = [f"wörd{i}" for i in range(5000)]
    rows = {i * 7 - 50: " ".join(rng.choices(words, k=rng.choice([3, 40, 300, 900]))) for i in range(60)}
    rows |= {1001: None, 1002: "", 1003: " \t ", 1004: "one", 1005: rows[-50], 1006: "😀é" * 10}
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows.items()] + [(1004, "one", None, None), (None, "z", None, None)], SCHEMA).repartition(5)
    out = {r["doc_id"]: r for r in fp.fingerprint_digest(docs).collect()}
    assert set(out) == set(rows)
    want = edits(rows)
    errors = []
    for i, r in out.items():
        t = rows[i] or ""
        edited, nxt = want[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == 256 and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        errors += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, nxt)]
    assert out[1005]["fingerprint"] == out[-50]["fingerprint"]
    assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.25


def test_estimate_is_unbiased(spark):
    rng = random.Random(8)
    pairs = []
    for k in range(200):
        a = [f"w{rng.random()}" for _ in range(400)]
        b = list(a)
        for _ in range(1 + k % 40):
            b[rng.randrange(400)] = f"x{rng.random()}"
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    got = df.select("a", "b", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("s")).collect()
    errors = np.array([r["s"] - jaccard(r["a"], r["b"]) for r in got])
    assert abs(errors.mean()) < 0.012 and errors.std() < 0.06


def plain_bins(hashes, mix):
    """Optimal densification over a dict of filled bins, with the hash of (bin, attempt) given."""
    own = {}
    for x in sorted(h & (2**63 - 1) for h in hashes):
        own.setdefault(x >> 56, x)
    out = []
    for j in range(fp.BINS):
        source = j
        if j not in own:
            source = next((d for t in range(1, fp.ATTEMPTS[-1] + 1) if (d := mix[j, t] % fp.BINS) in own), min(own))
        out.append((own[source], j))
    return out


def test_bins_against_a_plain_densification(spark):
    draws = spark.range(fp.BINS).selectExpr("cast(id as int) j").crossJoin(spark.range(1, fp.ATTEMPTS[-1] + 1).selectExpr("cast(id as int) t")).select("j", "t", F.xxhash64("j", "t").alias("h"))
    mix = {(r["j"], r["t"]): r["h"] for r in draws.collect()}
    texts = [" ".join(f"t{n}x{i}" for i in range(n + 4)) for n in (1, 2, 3, 9, 40, 300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fp.shingle_hashes(fp.words_of(F.col("t"))).alias("h"), fp.bins(F.col("t")).alias("b")).collect()
    want = [plain_bins(r["h"], mix) for r in rows]
    flat = spark.createDataFrame([(k, j, x) for k, w in enumerate(want) for x, j in w], "k int, j int, x long").select("k", "j", F.xxhash64("x", "j").bitwiseAND(F.lit(255)).alias("v")).collect()
    value = {(r["k"], r["j"]): r["v"] for r in flat}
    for k, r in enumerate(rows):
        got = [x >> 8 * (7 - i) & 255 for x in r["b"] for i in range(8)]
        assert got == [value[k, j] for j in range(fp.BINS)]


def test_variance_for_short_texts(spark):
    """Of n shingles a and b share half the union: the estimate's spread must be near what optimal densification has, not a walk's."""
    rng = random.Random(12)
    for n in (8, 20, 50):
        pairs = []
        for _ in range(300):
            shared = [f"s{rng.random()}" for _ in range(2 * n // 3)]
            a, b = ([f"{x}{rng.random()}" for _ in range(n // 3)] for x in "ab")
            pairs.append((shared + a, shared + b))
        df = spark.createDataFrame(pairs, "a array<string>, b array<string>").repartition(4)
        own = lambda c: fp._bins(F.transform(F.col(c), lambda w: F.xxhash64(w)))
        got = np.array([r["s"] for r in df.select(fp.bin_likeness(own("a"), own("b")).alias("s")).collect()])
        true = (2 * n // 3) / (2 * n // 3 + 2 * (n // 3))
        filled = fp.BINS * (1 - (1 - 1 / fp.BINS) ** n)
        least = true * (1 - true) / filled  # the variance if the filled bins were all
        assert abs(got.mean() - true) < 0.03 and got.var() < 2.2 * least, (n, got.var(), least)


def test_texts_of_one_id_give_one_consistent_row(spark):
    rows = [(1, "b"), (1, "aaaaaa"), (2, "cdefgh")]
    out = {r["doc_id"]: r for r in fp.fingerprint_digest(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)).collect()}
    assert len(out) == 2 and out[1]["n_chars"] in (1, 6)
    text = {1: "b", 6: "aaaaaa"}[out[1]["n_chars"]]
    assert out[1]["edited_sha256"] == hashlib.sha256(edits({1: text, 2: "cdefgh"})[1][0].encode()).hexdigest()
    assert out[2]["edited_sha256"] == hashlib.sha256(edits({1: text, 2: "cdefgh"})[2][0].encode()).hexdigest()


def test_empty_and_single(spark):
    assert fp.fingerprint_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    r = fp.fingerprint_digest(spark.createDataFrame([(3, "a b c d e f", None, None)], SCHEMA)).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0 and r[0]["edited_sha256"] == hashlib.sha256(b"a b c d a b").hexdigest()
