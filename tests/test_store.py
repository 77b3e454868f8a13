from datetime import date, datetime, timedelta

from emberline.sources import store

NOW = datetime(2024, 5, 6, 7, 8, 9)
ANSWERS = [("a", "q1", 200, "one"), ("a", "q2", 500, "broken"), ("a", "q3", 200, None), ("b", "q1", 201, "other"), ("a", "q1", 200, "one more")]


def answers(spark, rows):
    return spark.createDataFrame(rows, "source string, request string, status int, body string")


def content(spark, path, now=NOW, age=None):
    return sorted((r["source"], r["request"], r["body"]) for r in store.fresh(spark, path, now, age).collect())


def test_three_runs_and_a_crash(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.remember(answers(spark, ANSWERS), path, NOW) == 2
    want = [("a", "q1", "one"), ("b", "q1", "other")]
    assert content(spark, path) == want
    before = store.committed(spark, path)
    assert store.remember(answers(spark, ANSWERS), path, NOW) == 0 and store.committed(spark, path) == before  # nothing is written
    later = NOW + timedelta(days=1)
    # a run that died before its manifest entry: its folder isn't read, and the run, repeated, finds the same news
    answers(spark, [("a", "q9", 200, "lost")]).selectExpr("'x' AS digest", "source", "request", "body", "current_timestamp() AS fetched_at").write.parquet(f"{path}/rows/half-written")
    assert content(spark, path, later) == want
    assert store.remember(answers(spark, [("a", "q2", 200, "mended")]), path, later) == 1
    assert content(spark, path, later) == sorted([*want, ("a", "q2", "mended")]) and content(spark, path) == want


def test_old_answers_are_asked_again(spark, tmp_path):
    path, week = str(tmp_path / "store"), timedelta(days=7)
    store.remember(answers(spark, ANSWERS), path, NOW)
    asked = spark.createDataFrame([("a", "q1"), ("a", "q2"), ("a", "q1")], "source string, request string")
    left = lambda now, age=week: sorted(r["request"] for r in store.wanted(asked, path, now, age).collect())
    assert left(NOW) == ["q2"] and left(NOW + timedelta(days=8)) == ["q1", "q2"] and left(NOW + timedelta(days=8), None) == ["q2"]
    late = NOW + timedelta(days=8)
    assert store.remember(answers(spark, [("a", "q1", 200, "new")]), path, late, week) == 1
    assert content(spark, path, late) == [("a", "q1", "new"), ("b", "q1", "other")] and content(spark, path, late, week) == [("a", "q1", "new")]


def walk(pages, cutoff):
    """Page after page, as a reader would."""
    out, seen = [], set()
    for n in range(1, 121):
        if n not in pages:
            break
        new = [i for i in pages[n] if i[1] and i[1] not in seen]
        if not new:
            break
        seen |= {i[1] for i in new}
        out += new
        days = [i[2] for i in pages[n] if i[2]]
        if days and min(days) < cutoff:
            break
    return sorted((i[0], i[1]) for i in out if not i[2] or i[2] >= cutoff)


def test_paging_equals_a_walk(spark):
    d = lambda k: date(2024, 1, 31) - timedelta(days=k)
    feeds = {
        1: {1: [(0, "a", d(0)), (1, "b", d(1))], 2: [(0, "b", d(1)), (1, "c", d(40)), (2, "d", None)], 3: [(0, "e", d(2))]},  # ends at page 2
        2: {1: [(0, "a", d(0))], 2: [(0, "a", d(0))], 3: [(0, "z", d(1))]},  # page 2 has nothing new
        3: {1: [(0, "a", None)], 3: [(0, "z", d(1))]},  # page 2 isn't there
        4: {2: [(0, "a", d(0))]}, 5: {1: [(0, "", d(0)), (1, None, d(0))]}, 6: {1: [(0, "a", d(0)), (1, "a", d(0))], 2: [(0, "b", None)]},
        7: {n: [(0, f"u{n}", d(0))] for n in range(1, 131)},
    }
    rows = [(f, n, p, u, t, "kept") for f, pages in feeds.items() for n, own in pages.items() for p, u, t in own]
    items = spark.createDataFrame(rows, "feed int, page int, position int, url string, published date, last string").repartition(3)
    got = store.paged_back(items, date(2024, 1, 1)).collect()
    for f, pages in feeds.items():
        assert sorted((r["position"], r["url"]) for r in got if r["feed"] == f) == walk(pages, date(2024, 1, 1)), f
