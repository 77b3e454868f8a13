import random
from difflib import SequenceMatcher

import pytest

from emberline.operators import dedup, fuzzy
from emberline.operators.components import connected_components
from pyspark.sql import functions as F


def test_similar_names_equal_every_pair(spark):
    rng = random.Random(41)
    names = ["", "", "a", "a", "ab", "ab", "abc", "abd", "aaaaaaa", "aaaaaaab", "abababab", "ababababab"]
    for _ in range(60):
        base = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 6)))
        names.append(base)
        for _ in range(3):
            own = list(base)
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randrange(2)] = rng.choice(["", "x", "ab"])
            names.append("".join(own))
    rng.shuffle(names)
    want = {(j, i, SequenceMatcher(None, names[j], names[i]).ratio()) for i in range(len(names)) for j in range(i + 1, len(names))}
    items = spark.createDataFrame(list(enumerate(names)), "id long, key string").repartition(3)
    for least in (0.86, 0.7):
        got = {(r["later"], r["earlier"], r["ratio"]) for r in fuzzy.similar_pairs(items, least).collect()}
        close = {w for w in want if w[2] > least}
        assert got == close and len(close) > 50
    with pytest.raises(ValueError):
        fuzzy.similar_pairs(items, 0.6)


def test_two_words_that_all_hold_link_as_a_star(spark):
    rows = [(k, ["machine", "learning", f"x{k}", f"y{k}", f"z{k}", f"q{k}"]) for k in range(200)] + [(500, ["x7"]), (501, ["solar", "cell"]), (502, ["solar", "cell", "film"]), (503, ["lone", "one", "more", "here"])]
    items = spark.createDataFrame(rows, "id long, words array<string>")
    links = dedup.technology_links(items, "words")
    assert links.count() <= 205
    every = dedup.word_pairs(items, "words", dedup.same_technology(F.col("a"), F.col("b")))
    named = lambda e: {r["node"]: r["component"] for r in connected_components(e, "later", "earlier").collect()}
    assert named(links) == named(every) and every.count() > 19_000
