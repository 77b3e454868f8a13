from datetime import date

from emberline.operators import rollup

AS_OF = date(2024, 6, 30)
WORKS = "tech_id int, provider string, window int, position int, doi string, title string, published string, institutions array<string>, countries array<string>, industry_share double"


def work(window, doi, title, day, provider="crossref", position=0, share=None, tech=1):
    return (tech, provider, window, position, doi, title, day, ["I1"], ["C1"], share)


def answered(spark, failed=()):
    return spark.createDataFrame([(1, p, w, (p, w) not in failed) for p in rollup.PROVIDERS for w in range(4)], "tech_id int, provider string, window int, ok boolean")


def test_one_work_by_doi_or_title(spark):
    works = spark.createDataFrame([
        work(0, "https://doi.org/10.1/A", "One", "2024-01-02", share=0.5), work(0, "10.1/a ", "Other title", "2023-05-05", "openalex", share=1.0),  # one work, the first provider's record
        work(0, None, "No doi!", "2023-07-01"), work(0, "", "no  DOI", "2023-07-02", "openalex"), work(0, "10.1/b", " ?", "2023-07-02"),  # the last has no title
        work(1, "10.1/c", "C", "2022-01-01"), work(1, "10.1/d", "D", "2021-06-29"), work(1, "10.1/A", "One again", "2022-03-03"),
        work(3, "10.1/e", "", "2001-02-03"), work(3, "10.1/e", "E", "2000-01-01", position=1), work(3, None, None, "1999-01-01"),
    ], WORKS)
    r = rollup.science_rollup(works, answered(spark), AS_OF).first()
    assert (r["window_0"], r["window_1"], r["window_2"], r["count_3y"], r["total"], r["first_date"]) == (2, 3, 0, 4, 5, "1999-01-01")
    assert r["history_complete"] and r["recent_3y_complete"] and r["ok"] and not r["recent_results_capped"] and r["industry_affiliation_share_3y"] == 0.5
    years = {x["year"]: x["n"] for x in rollup.science_years(works, answered(spark), AS_OF).collect()}
    assert min(years) == 1999 and max(years) == 2024 and {y: n for y, n in years.items() if n} == {1999: 1, 2001: 1, 2021: 1, 2022: 1, 2023: 1, 2024: 1}


def test_failed_requests_leave_years_unknown(spark):
    works = spark.createDataFrame([work(0, None, "T", "2024-01-02")], WORKS)
    one, two = {("crossref", 1)}, {("crossref", 1), ("openalex", 1), ("crossref", 3)}
    assert rollup.science_rollup(works, answered(spark, one), AS_OF).first()["history_complete"]
    r = rollup.science_rollup(works, answered(spark, two), AS_OF).first()
    assert not r["history_complete"] and not r["recent_3y_complete"] and r["ok"] and r["first_date"] == "2024-01-02"
    years = {x["year"]: x["n"] for x in rollup.science_years(works, answered(spark, two), AS_OF).collect()}
    assert years == {2019: 0, 2020: None, 2021: None, 2022: None, 2023: 0, 2024: 1}  # 2018 and the days of window 1
    gone = rollup.science_rollup(works.limit(0), answered(spark, {(p, w) for p in rollup.PROVIDERS for w in range(4)}), AS_OF).first()
    assert not gone["ok"] and gone["total"] == 0 and gone["first_date"] is None


SOURCES = "candidate_id int, source_id string, status string, duplicate_of string, type string, channel string, provider string, connector string, event_type string, published_at string, event_date string"


def test_unknown_channel_years_are_filled(spark):
    measured = spark.createDataFrame([(1, "patents", 2020, None), (1, "patents", 2021, 0), (1, "patents", 2022, 5), (1, "news", 2018, None), (1, "news", 2023, None), (2, "news", 2020, None)], "candidate_id int, channel string, year int, n long")
    s = lambda id_, day, type_=None, channel=None, status="read", dup=None, event=None, provider=None, event_day=None, c=1: (c, id_, status, dup, type_, channel, provider, None, event, day, event_day)
    sources = spark.createDataFrame([
        s("a", "2020-05-05", "patent"), s("a", "2020-05-05", "patent"), s("b", "2021-01-01", provider="google_patents"), s("c", "2019-01-01", "patent"), s("d", None, "Patent"), s("e", "soon", "patent"),
        s("f", "2018-02-02", channel="market"), s("g", "2023-02-02", channel="market"), s("h", "2020-01-01", "patent", status="failed"), s("i", "2020-01-01", "patent", dup="a"),
        s("j", "2016-06-06", event="deployment"), s("k", "2030-01-01", "patent"), s("l", None, "patent", event_day="2019-03-03T00:00:00"), s("m", "2020-01-01", "patent", c=2),
    ], SOURCES)
    got = {(r["candidate_id"], r["channel"], r["year"]): r["n"] for r in rollup.fill_channel_years(measured, sources, AS_OF).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {(1, "patents", 2019): 2, (1, "patents", 2020): 1, (1, "patents", 2021): 0, (1, "patents", 2022): 5, (1, "news", 2018): 1}
    assert {y for c, ch, y in got if c == 1 and ch == "news"} == set(range(2016, 2024)) and (2, "news", 2020) in got  # the deployment of 2016 widens the years
    row = rollup.fill_channel_years(measured, sources, AS_OF).where("candidate_id = 1 AND channel = 'patents' AND year = 2022").first()
    assert row["capped"] and row["undated_patents"] == 2
