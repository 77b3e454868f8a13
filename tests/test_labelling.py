import itertools

from emberline.operators import labelling


def test_claimed_names_against_the_plain_loop(spark):
    words = ["quantum", "sensor", "array", "fibre", "laser", "an"]
    rows = [(i, " ".join(x)) for i, x in enumerate(itertools.islice(itertools.permutations(words, 3), 60))] + [(60, None), (61, "a an"), (62, "Quantum-Sensor; ARRAY")]
    kept, want = [], {}
    for i, name in rows:
        own = {w for w in "".join(ch if ch.isalnum() else " " for ch in (name or "").lower()).split() if len(w) > 3}
        want[i] = bool(own) and not any(len(own & k) / len(own | k) > 0.6 for k in kept)
        if want[i]:
            kept.append(own)
    got = labelling.claim_names(spark.createDataFrame(rows, "id long, name string"))
    assert {r["id"]: r["claimed"] for r in got.collect()} == want


def test_excluded_terms_without_words(spark):
    terms = spark.createDataFrame([(None,), ("",), ("ai robots",), ("solid state cell",)], "term string")
    assert labelling.excluded_terms(terms, terms.limit(0)).count() == 0
    assert [r["term"] for r in labelling.excluded_terms(terms, spark.createDataFrame([("Solid-state",), (None,)], "term string")).collect()] == ["solid state cell"]
