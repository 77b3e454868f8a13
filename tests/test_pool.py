from datetime import date

from emberline.operators import pool

FACTS = "id int, title string, n_articles int, stage int, stage_quote string, wiki_stage int, wiki_age double, wiki_revision string, established string"


def test_any_of_three_sources_vetoes(spark):
    f = lambda id_, n=2, stage=2, wiki=None, age=None, year=None: (id_, "t", n, stage, "quote " * 40, wiki, age, "2019-01-02T00:00:00Z" if wiki else None, year)
    rows = spark.createDataFrame([f(1), f(2, stage=5), f(3, wiki=5, age=1.0), f(4, wiki=2, age=7.4), f(5, wiki=2, age=7.0), f(6, year="2012"), f(7, year="2013"), f(8, year="3000"), f(9, year="soon"), f(10, n=0, stage=5), f(11, n=None), f(12, stage=None)], FACTS)
    got = {r["id"]: (r["label"], r["decision"], r["reason"]) for r in pool.retro_labels(rows, date(2020, 6, 30), date(2024, 1, 1)).collect()}
    quote = ("quote " * 40)[:120]
    assert got == {
        1: ("1", "keep", f"stage 2: {quote}"), 2: ("0", "keep", "mature then (articles)"), 3: ("0", "keep", "mature then (encyclopaedia of 2019-01-02)"), 4: ("0", "keep", "mature then (its article is 7 years old)"),
        5: ("1", "keep", f"stage 2: {quote}"), 6: ("0", "keep", "mature then (known since 2012)"), 7: ("1", "keep", f"stage 2: {quote}"), 8: ("1", "keep", f"stage 2: {quote}"), 9: ("1", "keep", f"stage 2: {quote}"),
        10: (None, "drop", "no documents on the day"), 11: (None, "drop", "no documents on the day"), 12: ("1", "keep", f"stage unknown: {quote}"),
    }


def test_mature_parents(spark):
    positives = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id int, title string")
    parents = spark.createDataFrame([(2, "p", "Parent", 5), (1, "p", "Parent", 5), (3, "q", "Young", 3), (9, "r", "Nobody's", 5)], "id int, parent_id string, parent_title string, wiki_stage int")
    assert [(r["id"], r["title"], r["reason"]) for r in pool.parent_negatives(positives, parents).collect()] == [("p", "Parent", "mature counterpart of one")]


def test_two_runs_keep_assignments(spark):
    schema = "id string, domain string, assigned_to string, status string, note string"
    old = spark.createDataFrame([("a", "x", "ann", "done", "1"), ("b", "x", "", None, "1"), ("c", "y", "eve", "open", "1"), (None, "y", "lost", "done", "1"), ("d", "x", "", "new", "1"), ("d", "x", "bob", "open", "2"), ("n", None, "", "new", "1")], schema)
    run = spark.createDataFrame([("a", "x", "", "new", "2"), ("b", "x", "", "new", "2"), ("e", "x", "", "new", "2"), ("d", "x", "", "new", "2"), ("c", "x", "", "new", "2")], schema)
    once = pool.merge_pool(old, run, ["x"])
    want = sorted([("a", "x", "ann", "done", "2"), ("b", "x", "", "new", "2"), ("e", "x", "", "new", "2"), ("d", "x", "bob", "open", "2"), ("c", "x", "", "new", "2"), ("c", "y", "eve", "open", "1"), ("n", None, "", "new", "1")], key=str)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(once) == want and rows(pool.merge_pool(once, run, ["x"])) == want
    assert rows(pool.merge_pool(old, run.limit(0), [])) == rows(old.where("id is not null"))
