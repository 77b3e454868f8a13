import json
from datetime import date

from emberline.sources import connectors

ALL = connectors.registered()
DAY = date(2024, 3, 1)


def run(spark, name, body, **how):
    how = {"as_of": DAY} | how
    return ALL[name].run(spark.createDataFrame([(json.dumps(body),), ("junk",), (None,)], "body string"), **how).collect()


def work(doi, published, created=None, abstract="Prompt injection in language models. " * 8, title="A work"):
    return {"DOI": doi, "title": [title], "abstract": abstract, "published": {"date-parts": [published]}, "created": created and {"date-time": created}}


def test_crossref_knows_no_later_records(spark):
    body = {"message": {"items": [work("10.1/A", [2023, 5, 6], "2023-05-07T00:00:00Z"), work("10.1/late", [2022, 1, 1], "2024-03-02T00:00:00Z"), work("10.1/same", [2022], "2024-03-01T23:00:00Z"), work("10.1/none", [2022, 2]), work("10.1/old", [2021, 2, 1]), work("10.1/short", [2023], abstract="x")]}}
    assert {r["source_id"] for r in run(spark, "crossref", body)} == {"10.1/a", "10.1/same", "10.1/none"}
    assert {r["source_id"] for r in run(spark, "crossref", body, as_of=date(2024, 3, 2))} == {"10.1/a", "10.1/same", "10.1/none", "10.1/late"}
    assert len(run(spark, "crossref", body, terms=["prompt injections"])) == 3 and run(spark, "crossref", body, terms=["insulin pump"]) == [] == run(spark, "crossref", body, terms=[])


def test_the_news_index_keeps_three_months(spark):
    body = {"articles": [{"url": f"https://n/{d}", "title": "T", "seendate": f"{d}120000"} for d in ("20240301", "20240302", "20231205", "20231204", "20231101")] + [{"url": "https://n/undated", "title": "T", "seendate": "x"}]}
    ids = lambda **how: {r["source_id"].rpartition("/")[2] for r in run(spark, "gdelt", body, **how)}
    assert ids() == {"20240301", "20231205", "20231204", "20231101", "undated"}  # the day of the run isn't told
    assert ids(today=DAY) == {"20240301", "20231205", "undated"}
    assert ids(today=date(2024, 5, 28)) == {"20240301", "undated"} and ids(today=date(2024, 5, 29)) == set()


def test_sources_are_asked_for_their_topics_alone(spark):
    models = [{"modelId": "org/red-teaming_guard", "pipeline_tag": "text-classification", "tags": ["safety", "prompt"], "downloads": 7, "lastModified": "2024-01-02T03:04:05Z"}, {"id": "org/cat-pictures", "tags": None}, {"id": " "}]
    got = run(spark, "huggingface", models, terms=["red teaming of language models", "red teaming"])
    assert [(r["source_id"], r["title"], r["amount"]) for r in got] == [("org/red-teaming_guard", "Hugging Face model org/red-teaming_guard", 7.0)]
    assert got[0]["text"] == "Public Hugging Face model: org/red-teaming_guard. Task: text-classification. Downloads: 7; likes: 0; last update: 2024-01-02. Tags: safety, prompt."
    assert run(spark, "huggingface", models, terms=["red concrete teaming"]) == [] and len(run(spark, "huggingface", models)) == 2
    study = {"studies": [{"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "Pump"}, "statusModule": {"studyFirstPostDateStruct": {"date": "2023-04"}}}}]}
    assert run(spark, "clinicaltrials", study, terms=["solid state battery"]) == []
    assert [r["text"] for r in run(spark, "clinicaltrials", study, terms=["insulin pump"])] == ["Clinical study NCT1. Title: Pump. Study type: unknown. Status: unknown. First posted: 2023-04-01. "]


def test_texts_of_device_and_drug_records(spark):
    device = {"results": [{"device_name": "Pump", "k_number": "K1", "decision_date": "2023-02-03", "decision_description": "SE", "product_code": "ABC"}, {"device_name": "", "k_number": "K2"}]}
    assert [r["text"] for r in run(spark, "openfda_510k", device)] == ["FDA 510(k) medical-device record. Device: Pump. Decision: SE. Decision date: 2023-02-03. Applicant: unknown. Product code: ABC. K-number: K1."]
    drugs = {"results": [{"application_number": "N1", "products": [{"brand_name": "", "active_ingredients": [{"name": "X"}]}], "submissions": [{"submission_status_date": "20230405"}]}, {"application_number": "N2"}]}
    got = {r["source_id"]: r["text"] for r in run(spark, "openfda_drugs", drugs)}
    assert got == {"N1": 'FDA drug approval record. Product: [{"name":"X"}]. Application: N1. Latest submission date: 2023-04-05.', "N2": "FDA drug approval record. Product: FDA drug record. Application: N2. Latest submission date: unknown."}


def test_calls_say_what_they_are(spark):
    call = lambda kind, day: {"metadata": {"type": [kind], "identifier": ["ID"], "title": ["T"], "callTitle": ["C"], "startDate": [day]}}
    got = run(spark, "sedia", {"results": [call("1", "2024-02-02"), call("9", "2020-01-01")]})
    assert [(r["kind"], r["text"]) for r in got] == [("grant_call", "EU funding call: T. Published: 2024-02-02. Reference: ID.\n\nC")]
