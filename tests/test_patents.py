from datetime import date

from emberline.sources import epo

BIBLIO = """{"ops:world-patent-data": {"exchange-documents": {"exchange-document": %s}}}"""
ONE = """{"@country": "US", "@doc-number": "1", "@kind": "B2", "bibliographic-data": {"invention-title": {"@lang": "en", "$": "Prompt <i>guard</i>"},
  "publication-reference": {"document-id": [{"@document-id-type": "docdb", "date": {"$": "20230405"}}]}, "priority-claims": {"priority-claim": {"document-id": {"@document-id-type": "epodoc", "date": {"$": "202101"}}}},
  "parties": {"applicants": {"applicant": {"applicant-name": {"name": {"$": "Acme"}}}}}}, "abstract": {"p": {"$": "Detects prompt injection."}}}"""
MANY = """{"@country": "EP", "@doc-number": 2, "bibliographic-data": {"invention-title": [{"@lang": "de", "$": "Erster"}, {"@lang": "fr", "$": "Second"}],
  "publication-reference": {"document-id": {"@document-id-type": "other", "date": {"$": "19990101"}}}, "application-reference": {"document-id": [{"@document-id-type": "docdb"}, {"@document-id-type": "docdb", "date": {"$": "1998"}}]}}}"""


def bodies(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "body string")


def test_an_object_and_an_array_are_read_alike(spark):
    as_object, as_array = epo.records(bodies(spark, BIBLIO % ONE)).collect(), epo.records(bodies(spark, BIBLIO % f"[{ONE}, {MANY}]")).orderBy("number").collect()
    assert as_object[0] == as_array[1] and tuple(as_object[0]) == ("US1B2", "Prompt guard", "Detects prompt injection.", "Acme", date(2023, 4, 5), date(2021, 1, 1))
    assert tuple(as_array[0]) == ("EP2", "Erster", "", "", None, date(1998, 1, 1))


def test_broken_and_empty_answers(spark):
    assert epo.records(bodies(spark, "no json", None, "{}", "[]", '{"ops:world-patent-data": null}', BIBLIO % "null", BIBLIO % "[]")).count() == 0
    rows = epo.records(bodies(spark, BIBLIO % '{"bibliographic-data": "odd"}', BIBLIO % '{"bibliographic-data": {"invention-title": "bare", "parties": []}}')).orderBy("title").collect()
    assert [r["title"] for r in rows] == ["", "bare"]


def test_references_by_day_and_topic(spark):
    found = epo.records(bodies(spark, BIBLIO % f"[{ONE}, {MANY}]"))
    known = lambda day, phrases=None: sorted(r["source_id"] for r in epo.references(found, day, phrases).collect())
    assert known(date(2024, 1, 1)) == ["EP2", "US1B2"] and known(date(2022, 1, 1)) == ["EP2"] and known(date(1990, 1, 1)) == []
    assert known(date(2024, 1, 1), ["prompt injection"]) == ["US1B2"] and known(date(2024, 1, 1), []) == []


def test_search_numbers(spark):
    ref = '{"document-id": {"country": {"$": "EP"}, "doc-number": {"$": "7"}, "kind": {"$": "A1"}}}'
    answer = '{"ops:world-patent-data": {"ops:biblio-search": {"@total-result-count": "%s", "ops:search-result": {"ops:publication-reference": %s}}}}'
    got = [(r["total"], r["numbers"]) for r in epo.found_numbers(bodies(spark, answer % ("12", ref), answer % ("x", f"[{ref}, {{}}]"), "junk")).collect()]
    assert got == [(12, ["EP.7.A1"]), (0, ["EP.7.A1"])]
