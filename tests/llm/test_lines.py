import hashlib
from collections import defaultdict

import pytest

from emberline.llm import lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_bitmap string"


def brute(rows):
    docs = {i: (t or "") for i, t in rows}
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in docs.items():
        for x in t.split("\n"):
            held[key(x)].add(i)
    out = {}
    for i, t in docs.items():
        own = t.split("\n")
        keep = [x for x in own if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and i != max(held[key(x)]))]
        out[i] = (len(own), len(own) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


@pytest.mark.parametrize("n_copies", [0, 200])
def test_against_brute_force(spark, n_copies):
    common, wide = "A line that many documents share", "éèê" * 7
    rows = [(1, common + "\nown line of document one, long"), (2, " " + common.upper() + "\t\n" + wide), (3, common + "\nshort\n" + wide), (4, wide), (5, None), (6, ""), (7, "short\nshort"), (8, "short")]
    rows += [(9, "twice but only in two documents"), (10, "twice but only in two documents"), (-3, wide + "\n" + wide), (11, "x" * 19), (12, "x" * 19), (13, "x" * 19)]
    rows += [(100 + i, f"{common}\nunique to document number {i}") for i in range(n_copies)]
    docs = spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in lines.line_dedup_digest(docs).collect()}
    assert got == brute(rows)


def test_runs_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_against_brute_force(spark, 200)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table_and_repeated_rows(spark):
    assert lines.line_dedup_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "some line of a repeated row", None, None, None, None)] * 4 + [(None, "some line of a repeated row", None, None, None, None)], SCHEMA)
    got = lines.line_dedup_digest(docs).collect()
    assert len(got) == 4 and {r["n_dropped"] for r in got} == {0}


def test_bitmaps_change_texts(spark):
    rows = [(i, f"a line in every document, dropped\nkept {i}") for i in range(1, 5)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in rows] + [(9, None, None, None, None, None)], SCHEMA)
    out = {r["doc_id"]: r for r in lines.apply_bitmaps(docs, lines.line_keep_bitmaps(docs)).collect()}
    assert out[1]["text"] == "kept 1" and out[4]["text"] == rows[3][1] and out[9]["text"] is None
    assert out[1]["n_chars"] == 6 and out[1]["keep_bitmap"] == "x" and set(out[1].asDict()) == set(docs.columns)
