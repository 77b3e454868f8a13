import random
import zlib

import pytest

from emberline.llm import langid

SCHEMA = "doc_id long, text string, lang string, score double, accepted string"
WORDS = {"aa": ["lorka", "temri", "vosna", "klept"], "bb": ["ñuez", "ciónar", "osll", "jaque"], "cc": ["ßung", "heitä", "üver", "keit"]}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join("".join(rng.choices(WORDS[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), lang, 0.0, "x"))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(1001, None, "aa", None, None), (1002, "", "bb", None, None), (1003, "123 ... 45", "cc", None, None), (1004, "ñuez osll", None, None, None), (None, "ñuez", "bb", None, None), (1005, "ñuez ciónar " * 40_000, "bb", None, None)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in langid.language_digest(docs).collect()}
    assert len(got) == len(rows) + 5
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [i for i, *_ in rows if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.97 * len(held)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert got[1005]["lang_pred"] == "bb" and got[1004]["lang_pred"] == "bb"


def test_pieces_give_what_the_whole_gives(monkeypatch):
    import numpy as np

    text = "Ein längerer Text, ñ und so weiter. " * 50
    whole = np.sort(np.concatenate(list(langid.subwords(text, 16))))
    monkeypatch.setattr(langid, "PIECE", 64)
    cut = np.sort(np.concatenate(list(langid.subwords(text, 16))))
    assert (whole == cut).all()


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "some text", None, None, None) for i in range(5)], SCHEMA)
    assert {r["lang_pred"] for r in langid.language_digest(docs).collect()} == {"und"}
    assert langid.language_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_keeps_columns_and_rejects(spark):
    rows = corpus(200)
    docs = spark.createDataFrame(rows + [(900, "99 %%", "aa", None, None), (901, None, None, None, None)], SCHEMA)
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {900, 901} and len(ids) >= 198


@pytest.mark.parametrize("n", [0, 1, 3])
def test_tiny_training_sets(n):
    model = langid.train(["abc"] * n, ["x"] * n)
    assert langid.predict(model, "abc")[0] == ("x" if n else "und")


def test_documents_stay_where_no_language_was_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert langid.keep_identified(docs, langid.fit(docs)).count() == 2


def test_scores_against_a_plain_softmax():
    import math

    import numpy as np

    model = langid.train(["lorka temri vosna"] * 20 + ["ñuez ciónar jaque"] * 20, ["aa"] * 20 + ["bb"] * 20, bits=8, dim=4, epochs=3)
    text = "temri ciónar lork"
    ids = np.concatenate(list(langid.subwords(text, 8)))
    z = [sum(float(model.scores[i, k]) for i in ids) / len(ids) + float(model.bias[k]) for k in range(2)]
    e = [math.exp(v / model.temperature) for v in z]
    lang, score, _ = langid.predict(model, text)
    assert abs(score - max(e) / sum(e)) < 1e-6 and lang == model.langs[e.index(max(e))]
