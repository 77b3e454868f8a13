import random
import zlib

import numpy as np

from emberline.llm import quality

DOCS = "doc_id long, text string, score double, quality string, predicted string"


def corpus(n=500, seed=2):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if not good:
            text = [w + "%%%" for w in text] if rng.random() < 0.5 else [w for w in text for _ in range(6)]
        docs.append((i, " ".join(text), None, "clash", None))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, marks = corpus()
    odd = [(1001, None, None, None, None), (1002, "", None, None, None), (None, "word1", None, None, None), (1003, "word1 " * 200_000, None, None, None), (5, rows[5][1], None, None, None)]
    docs = spark.createDataFrame(rows + odd, DOCS).repartition(3)
    labels = spark.createDataFrame(marks + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.quality_digest(docs, labels).collect()
    assert len(out) == len(rows) + 4
    got = {r["doc_id"]: r for r in out}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i, *_ in rows if got[i]["held_out"]]
    assert np.mean([(got[i]["score"] >= 0.5) == marks[i][1] for i in held]) >= 0.95
    assert got[1001]["score"] == got[1002]["score"] and got[1003]["score"] < 0.3


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, None)], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.quality_digest(docs, labels).collect()] == [0.5]
    assert quality.quality_digest(spark.createDataFrame([], DOCS), labels).count() == 0


def test_pieces_give_what_the_whole_gives(monkeypatch):
    raw = ("Some words, and signs %%% || " * 40 + "x" * 500).encode()
    whole = np.sort(np.concatenate(list(quality.ngrams(raw, 18))))
    monkeypatch.setattr(quality, "PIECE", 64)
    cut = np.concatenate(list(quality.ngrams(b"Some words, and signs %%% || " * 40, 18)))
    monkeypatch.undo()
    assert (np.sort(np.concatenate(list(quality.ngrams(b"Some words, and signs %%% || " * 40, 18)))) == np.sort(cut)).all() and len(whole) > len(cut)


def test_texts_of_one_document_are_not_its_inputs():
    model = quality.train(["a b", "c d"] * 20, [1, 0] * 20)
    assert quality.score(model, b"a b") > 0.5 > quality.score(model, b"c d")


def test_score_against_a_plain_dot_product():
    import math

    model = quality.train(["good words here", "bad bad bad !!"] * 10, [1, 0] * 10, bits=10)
    text = "good bad words !! words"
    buckets = [int(i) for ids in quality.ngrams(text.encode(), 10) for i in ids]
    z = sum(float(model.weights[i]) for i in buckets) * model.scale / len(buckets) + model.bias
    assert abs(quality.score(model, text.encode()) - 1 / (1 + math.exp(-z))) < 1e-9
