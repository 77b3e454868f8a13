import hashlib
import random

import numpy as np
import pytest

from emberline.llm import substrings

SCHEMA = "doc_id long, text string, ranges string, bucket string"


def brute(rows, window=50):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.random()}" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 75, 130, 400)]
    rows = [(-1, None), (-2, ""), (-3, " \t")]
    for i in range(60):
        text = fresh(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            text += p + fresh(rng.randrange(0, 60))
        rows.append((rng.randrange(10**9), rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(10**10 + k, "loop " * 300) for k in range(3)] + [(10**10 + 10, "a b " * 90), (10**10 + 11, "b a " * 90), (10**10 + 12, rows[20][1]), (10**10 + 13, rows[20][1])]
    rows += [(10**11, "nb sp " * 80), (10**11 + 1, "nb sp " * 60), (10**11 + 2, " ".join(passages[5] * 3))]
    return rows


@pytest.mark.parametrize("flush", [1 << 20, 300])
def test_against_brute_force(spark, flush):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows] + [(None, rows[9][1], None, None)], SCHEMA).repartition(7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.substring_digest(docs, flush=flush).collect()}
    want = brute(rows)
    assert got == want and sum(v[1] > 0 for v in want.values()) > 15


def test_repeated_rows_and_empty_table(spark):
    assert substrings.substring_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"t{i}" for i in range(80))
    docs = spark.createDataFrame([(4, text, None, None)] * 3 + [(9, text, None, None)], SCHEMA)
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.substring_digest(docs).collect()) == [(4, 0)] * 3 + [(9, 80)]


def test_rolling_hashes_do_not_depend_on_place(monkeypatch):
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**63, 500).astype(np.uint64)
    w[300:400] = w[20:120]
    for which in (0, 1):
        h = substrings.rolling(w, 25, which)
        assert len(h) == 476 and (h[300:376] == h[20:96]).all() and len(np.unique(h)) == 476 - 76
        monkeypatch.setattr(substrings, "CHUNK", 64)
        assert (substrings.rolling(w, 25, which) == h).all()
        monkeypatch.undo()


def test_planes_round_trip():
    for kind in (np.int64, np.uint32):
        x = np.array([0, 1, 255, 70000, 5], kind)
        assert (substrings.unplanes(substrings.planes(x), kind) == x).all()
    assert len(substrings.unplanes(b"", np.uint32)) == 0


def test_cut_texts(spark):
    text = " ".join(f"t{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "x " + text, None, None), (2, text + " y", None, None)], SCHEMA)
    assert {r["doc_id"]: r["text"] for r in substrings.cut_texts(docs).collect()} == {1: "x " + text, 2: "y"}
