import math
import random

import duckdb
from emberline.operators.proximity import near_pairs
from emberline.plans import catalogue


def test_near_pairs_equal_every_pair(spark):
    rng = random.Random(5)
    docs = [(k if k % 9 else None, rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(60))) for k in range(60)] + [(7, ["a", "b", "c"]), (7, ["a", "b", "c"]), (99, None), (100, [])]
    items = [(k % 20, sorted(rng.sample("abcdefghijklmnop", rng.randrange(5)))) for k in range(40)]
    want = sorted(
        (-1 if d is None else d, i)
        for d, s in docs for i, k in items
        if s and k and any(len(set(k) & set(s[p : p + 12])) >= math.ceil(0.6 * len(k)) for p in range(max(len(s) - 11, 1)))
    )
    got = near_pairs(spark.createDataFrame(docs, "doc_id long, s array<string>").repartition(3), spark.createDataFrame(items, "item_id long, k array<string>"))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in got.collect()) == want and len(want) > 100


def test_query_keeps_rows_without_id_and_items_of_one_id(spark, tmp_path):
    far = "alpha " + "word " * 11 + "beta gamma"
    docs = [(None, "alpha beta gamma"), (1, far), (2, "delta x y epsilon alpha zeta"), (3, None), (3, "gamma word beta word alpha")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma omega"), (1, "delta epsilon zeta"), (2, "the")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = lambda data: sorted(map(repr, map(tuple, data)))
    got = rows(catalogue.queries()["proximity"](spark, str(tmp_path)).collect())
    assert got == rows(db.sql(catalogue.oracle_sql()["proximity"]).fetchall()) == rows([(None, 1), (2, 1), (3, 1)])


def test_stems_of_all_items_form_no_pairs(spark):
    items = spark.range(300).selectExpr("id AS item_id", "array('as', 'be', concat('x', id), concat('y', id)) AS k")
    docs = spark.range(50).selectExpr("id AS doc_id", "array('as', 'be', concat('x', id)) AS s")
    found = near_pairs(docs, items)
    assert {tuple(r) for r in found.collect()} == {(k, k) for k in range(50)}


def test_items_of_many_stems_equal_every_pair(spark):
    rng = random.Random(6)
    some = "abcdefghijklmnopqrstuvwxyz"
    items = [(k, sorted(rng.sample(some, rng.randrange(1, 24)))) for k in range(60)] + [(7, list("abcdef")), (8, list("abcdef"))]
    docs = [(k, rng.choices(some[: rng.randrange(8, 27)], k=rng.randrange(60))) for k in range(80)] + [(100 + i, [rng.choice("xyz"), *rng.sample(k, len(k)), "q"]) for i, k in items]
    want = sorted((d, i) for d, s in docs for i, k in items if s and any(len(set(k) & set(s[p : p + 12])) >= math.ceil(0.6 * len(k) - 1e-9) for p in range(max(len(s) - 11, 1))))
    got = near_pairs(spark.createDataFrame(docs, "doc_id long, s array<string>").repartition(3), spark.createDataFrame(items, "item_id long, k array<string>"))
    assert sorted(map(tuple, got.collect())) == want
    sizes = dict(items)
    assert sum(len(sizes[i]) > 5 for _, i in want) > 300 and max(len(sizes[i]) for _, i in want) > 16


def test_query_reads_all_stems_of_an_item(spark, tmp_path):
    words = "alpha bravo charlie delta echo foxtrot golf hotel"
    docs = [(1, "alpha bravo charlie delta"), (2, "hotel x golf y foxtrot z echo delta"), (3, "alpha bravo charlie " + "word " * 9 + "delta echo")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, words)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.queries()["proximity"](spark, str(tmp_path)).collect()]
    assert got == db.sql(catalogue.oracle_sql()["proximity"]).fetchall() == [(2, 1)]
