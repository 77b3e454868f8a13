from emberline.sources import catalog

HEAD = "№,Технология (слабый сигнал),Источники,Стадия развития"


def records(spark, *bodies):
    found = catalog.catalogue(catalog.grid(spark.createDataFrame([(f"s{k}", b) for k, b in enumerate(bodies)], "sheet string, body string")))
    return sorted(([r["sheet"], r["row"], r["id"], r["title"], r["stage"], [(x["title"], x["url"]) for x in r["links"]]] for r in found.collect()), key=str)


def test_the_header_is_found_wherever_it_stands(spark):
    body = f'﻿notes,1\r\n\r\n"a, ""b""\nc",2\r\n{HEAD}\r\n1,T,"[x](https://x/1) [bad](ftp://y) [z](http://z)",pilot\r\nno number,U,,\r\n2.0,"quoted, ""title""",,\r\n3,short'
    assert records(spark, body) == [["s0", 5, 1, "T", "pilot", [("x", "https://x/1"), ("z", "http://z")]], ["s0", 7, 2, 'quoted, "title"', None, []], ["s0", 8, 3, "short", None, []]]


def test_a_later_header_replaces_the_first(spark):
    body = f"{HEAD}\n1,A,,x\nИсточники,№,,Технология (слабый сигнал)\n[t](http://t),2,ignored,B\n"
    assert records(spark, body, "1,2,3", "", None) == [["s0", 2, 1, "A", "x", []], ["s0", 4, 2, "B", None, [("t", "http://t")]]]


def test_fallback_where_there_are_no_records(spark):
    some, none = spark.createDataFrame([(1, "a")], "id long, title string"), spark.createDataFrame([], "id long, title string")
    spare = spark.createDataFrame([(9, "z"), (8, "y")], "id long, title string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(catalog.or_fallback(some, spare)) == [1] and ids(catalog.or_fallback(none, spare)) == [8, 9]


def test_printed_numbers(spark):
    texts = ["cover", "a\nb\nc\nd\n 1 \ne\nf", "x\n2", "no", "7\n\n", None, "1234", "4\n5", "a\n9999\n6\n"]
    pages = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(2, 0, "x"), (2, 1, "")], "doc_id int, page int, text string")
    got = {(r["doc_id"], r["page"]): r["printed"] for r in catalog.printed_numbers(pages).collect()}
    # offsets 1 (pages 1 and 2), -2, 4 and 3: most pages are one ahead
    assert [got[1, k] for k in range(9)] == [0, 1, 2, 3, 7, 5, 6, 4, 6] and got[2, 0] == 1 and got[2, 1] == 2
