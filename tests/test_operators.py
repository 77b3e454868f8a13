"""Hand-made cases for edges that the driver tables don't have."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from emberline.functions import dates, money, stats, text, urls
from emberline.operators import dedup, evaluation, features, graph, ngrams, scoring, windows
from emberline.sources import captions, connectors, sinks
from emberline.sources.recorded import RecordedSource
from emberline.streaming.asof import windowed_activity


def one(spark, expr, schema="x string", value=None):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_windows_round_halves_to_even():
    assert [dates.days_of(y) for y in (0.5, 1, 1.5, 2, 3, 4, 6, 10)] == [183, 365, 548, 730, 1096, 1461, 2192, 3652]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Ex.org/a?utm_Source=1&b=2&FBCLID=3#top", "https://ex.org/a?b=2"), ("http://ex.org:8080/", None), ("http://ex.org:80", "http://ex.org:80/"), ("http://u:p@ex.org/", None),
        ("ftp://ex.org/", None), ("http:///x", None), ("https://ex.org?flag", "https://ex.org/?flag="), ("not a url", None), (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.col("x")), value=url) == want


@pytest.mark.parametrize("host, want", [("a.b.example.com", ["a.b.example.com", "b.example.com", "example.com"]), ("localhost", []), ("", [])])
def test_host_suffixes(spark, host, want):
    assert one(spark, urls.host_suffixes(F.col("x")), value=host) == want


@pytest.mark.parametrize("word, want", [("batteries", "batter"), ("boxes", "boxe"), ("agents", "agent"), ("gas", "gas"), ("battery", "batter"), ("квантовые", "квант"), ("ties", "ties")])
def test_stem(spark, word, want):
    assert one(spark, text.stem(F.col("x")), value=word) == want


def test_short_phrases_and_relevance(spark):
    assert sorted(one(spark, text.short_phrases(F.col("x")), value="automated red teaming platform")) == ["automated red", "automated red teaming", "red teaming"]
    assert one(spark, text.short_phrases(F.col("x")), value="квантовый sensor") == []
    near = text.near(text.stems(F.col("x")), text.key_stems(F.lit("quantum battery")))
    assert one(spark, near, value="quantum " + "filler " * 5 + "batteries") is True
    assert one(spark, near, value="quantum " + "filler " * 30 + "batteries") is False


@pytest.mark.parametrize(
    "said, want",
    [("Tue, 02 Jan 2024 23:30:00 -0200", date(2024, 1, 3)), ("2 Jan 2024 10:00:00 GMT", date(2024, 1, 2)), ("2024", date(2024, 1, 1)), ("2024-13-01", None), ("03/04/2021", date(2021, 3, 4)), ("garbage", None), (None, None)],
)
def test_iso_date(spark, said, want):
    assert one(spark, dates.iso_date(F.col("x")), value=said) == want


def test_money(spark):
    rows = spark.createDataFrame([("90", "EUR", 2015), ("90", "eur", 1999), ("x", "USD", 2020), ("5", "JPY", 2020), ("1000000", None, 2020)], "a string, c string, y int")
    got = [r["r"] for r in rows.select(money.to_usd_m(F.col("a"), F.col("c"), F.col("y")).alias("r")).collect()]
    assert got == [0.0001, 0.0001, None, None, 1.0]


def test_burstiness_and_hhi(spark):
    assert one(spark, stats.burstiness(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, stats.burstiness(F.array(*[F.lit(2.0)] * 4))) == -1.0
    assert one(spark, stats.hhi(F.array(F.lit(1.0), F.lit(3.0)))) == 0.625 and one(spark, stats.hhi(F.array().cast("array<double>"))) is None


def relations(spark, works=(), patents=(), news=(), events=()):
    return (
        spark.createDataFrame(list(works), "tech_id long, published date, citations int, preprint boolean, institution string, country string, industry_share double"),
        spark.createDataFrame(list(patents), "tech_id long, priority date, assignee string"),
        spark.createDataFrame(list(news), "tech_id long, published date, publisher string, host string, press boolean, high_trust boolean, unverifiable boolean"),
        spark.createDataFrame(list(events), "tech_id long, event_id string, type string, day date, company string, customer string, amount_usd_m double, round string, strategic boolean"),
    )


def vector(spark, ok, **more):
    snap = date(2024, 6, 30)
    status = spark.createDataFrame([(1, "d", ok, ok, ok, ok)], "tech_id long, domain string, science_ok boolean, patents_ok boolean, media_ok boolean, events_read boolean")
    judged = spark.createDataFrame([], "tech_id long, stage int, mass_market boolean, is_technology boolean, rebranding_similarity double")
    return features.feature_vector(snap, status, *relations(spark, **more), judged).first().asDict()


def test_unmeasured_is_not_zero(spark):
    off, on = vector(spark, False), vector(spark, True)
    assert len(features.FEATURES) == 63 and off["papers_log_3y"] is None and on["papers_log_3y"] == 0.0
    assert off["funding_log_24m"] is None and on["funding_log_24m"] == 0.0 and on["media_burstiness_12m"] is None and on["independent_media_domains_log_12m"] == 0.0
    assert off["missing_science"] == on["missing_science"] == 1.0 and off["is_technology_flag"] == 1.0 and on["patent_active_share"] is None


def test_events_on_the_cutoff_and_after_the_snapshot(spark):
    events = [
        (1, "a", "funding", date(2022, 7, 1), "Acme", None, 4.0, "A", True), (1, "b", "funding", date(2022, 6, 30), "acme ", None, 2.0, "seed", None), (1, "c", "funding", date(2024, 7, 1), "Late", None, 9.0, "b", None),
        (1, "d", "funding", date(2022, 7, 1), " ACME", None, 7.0, "A", True), (1, "e", "grant", date(2024, 1, 1), None, None, None, None, None),
    ]
    v = vector(spark, True, events=events)
    assert v["funding_round_count_24m"] == 1 and v["strategic_investor_count"] == 1 and v["commercial_vendor_count_log"] == pytest.approx(0.693147) and v["public_grants_log_36m"] == pytest.approx(0.693147)
    assert v["funding_log_24m"] == pytest.approx(1.609438) and v["missing_funding"] == 0 and v["cross_channel_confirmation_count"] == 1


def test_score_of_an_empty_row_is_the_median_row(spark):
    m = scoring.Artifact(("a", "b"), (1.0, 2.0), (0.5, 2.0), (1.0, 2.0), (2.0, 1.0), -0.5, 1.5, 0.1)
    r = scoring.score(spark.createDataFrame([(None, None), (1.0, 2.0)], "a double, b double"), m).collect()
    assert r[0]["logit"] == r[1]["logit"] == pytest.approx(1.5 * (-0.5 + 1.0) + 0.1) and all(x["imputed"] for x in r[0]["waterfall"][1:])
    assert sum(x["contribution"] for x in r[0]["waterfall"]) == pytest.approx(r[0]["logit"], abs=1e-3)
    with pytest.raises(ValueError):
        scoring.Artifact(("a",), (1.0,), (1.0,), (1.0,), (), 0.0)


def test_first_survivors_follow_the_greedy_rule(spark):
    rng = random.Random(4)
    for _ in range(3):
        n = 30
        pairs = {(a, b) for a in range(n) for b in range(a) if rng.random() < 0.08} | {(3, 2), (2, 1), (1, 0)}
        want = {}
        for i in range(n):
            want[i] = next((j for j in range(i) if want[j] is None and (i, j) in pairs), None)
        items = spark.range(n)
        got = {r["id"]: r["duplicate_of"] for r in dedup.first_survivors(items, spark.createDataFrame(list(pairs), "later long, earlier long")).collect()}
        assert got == want


def test_nested_phrases(spark):
    counts = spark.createDataFrame([("prompt injection attacks", 6), ("prompt injection", 10), ("injection attacks", 20), ("red team", 3)], "phrase string, n long")
    assert {r["phrase"] for r in ngrams.collapse_nested(counts).collect()} == {"prompt injection attacks", "injection attacks", "red team"}


def test_single_class_and_empty_metrics(spark):
    rows = spark.createDataFrame([(1, 0.4), (1, 0.9), (None, 0.5)], "y int, p double")
    assert tuple(evaluation.rank_metrics(rows, F.col("y"), F.col("p")).first()) == (None, None)
    assert evaluation.confusion(rows.where("false"), F.col("y"), F.col("p"), 0.5).first()["precision"] == 0.0
    assert evaluation.cohens_kappa(rows.where("false"), "y", "p").first()["kappa"] is None


def test_reserve_gives_free_room_to_the_channel(spark):
    rows = spark.createDataFrame([(i, "money" if i > 3 else "web") for i in range(1, 20)], "i long, ch string")
    assert sorted(r["i"] for r in windows.reserve_channel(rows, "i", "ch", "money", 6, 0.5).collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_graph_upsert_and_rollback(spark):
    a = spark.createDataFrame([("n", 1.0, ["s1"]), ("m", 2.0, ["s2"])], "id string, weight double, source_ids array<string>")
    b = spark.createDataFrame([("n", 3.0, ["s2"])], "id string, weight double, source_ids array<string>")
    got = {r["id"]: (r["weight"], r["source_ids"]) for r in graph.upsert(a, b, ["id"]).collect()}
    assert got == {"n": (3.0, ["s1", "s2"]), "m": (2.0, ["s2"])}
    assert [r["id"] for r in graph.remove_source(graph.upsert(a, b, ["id"]), F.lit("s2")).collect()] == ["n"]


def test_connectors(spark):
    assert len(connectors.REGISTRY) >= 14
    with pytest.raises(ValueError):
        connectors.register("rss", "market", "post")(lambda b: b)
    with pytest.raises(ValueError):
        connectors.Connector("x", "nowhere", "post", lambda b: b)
    assert {c.name for c in connectors.select(channel="market")} == {"bing_news", "clinicaltrials", "gdelt", "habr", "openfda_510k", "openfda_drugs", "rss"}
    assert {c.name for c in connectors.select(historical=True)} == {
        "arxiv", "clinicaltrials", "cordis", "crossref", "google_patents", "grants_gov", "habr", "nih", "nsf", "openalex", "openfda_510k", "openfda_drugs", "rss", "sec_edgar", "sedia", "ted",
        "usaspending", "venture_news", "yc",
    }
    body = '{"results": [{"project_title": "T", "award_amount": 5, "core_project_num": "P1", "award_notice_date": "2024-02-03T00:00:00"}, {"project_title": "Late", "core_project_num": "P2", "award_notice_date": "2025-01-01"}, {"project_title": "Undated", "core_project_num": "P3"}]}'
    df = spark.createDataFrame([(body,), ("not json",), (None,)], "body string")
    got = connectors.REGISTRY["nih"].run(df, date(2024, 6, 1)).collect()
    assert [(r["source_id"], r["observed_at"], r["channel"]) for r in got] == [("P1", date(2024, 2, 3), "money")]
    yc = '{"companies": [{"id": "1", "name": "A", "slug": "a", "batch": "W21"}, {"id": "2", "name": "B", "slug": "b", "batch": "??"}]}'
    assert {r["source_id"]: r["observed_at"] for r in connectors.yc(spark.createDataFrame([(yc,)], "body string")).collect()} == {"1": date(2021, 1, 1), "2": None}
    news = '[{"date": "2024-01-05T10:00:00", "link": "https://n/1", "title": {"rendered": "Acme &amp; Co raises $12M Series A"}, "excerpt": {"rendered": "<p>x</p>"}}]'
    r = connectors.venture_news(spark.createDataFrame([(news,)], "body string")).first()
    assert (r["company"], r["amount"], r["currency"], r["kind"]) == ("Acme & Co", 12e6, "USD", "funding_round")


def test_ukri_joins_three_records(spark):
    body = lambda x: spark.createDataFrame([(x,)], "body string")
    got = connectors.ukri(body('{"id": "P", "title": "T", "fund_id": "F", "org_id": "O"}'), body('{"id": "F", "start": 1719788400000, "valuePounds": {"amount": 7}}'), body('{"id": "X", "name": "n"}')).first()
    assert got["observed_at"] == date(2024, 7, 1) and got["company"] is None and got["amount"] == 7.0


def test_captions(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.500 --> 00:00:02.000\n<b>Hello</b>\nHello\n\n01:02:03.000 --> 01:02:04.000\nworld\n"
    assert captions.caption_lines(vtt) == [(1.5, "Hello"), (3723.0, "world")] and captions.caption_lines("a\n\nb") == [(None, "a"), (None, "b")]
    out = captions.parse_captions(spark.createDataFrame([(1, vtt), (2, None)], "id long, body string"), "id", "body").collect()
    assert [(r["id"], r["line"]) for r in out] == [(1, "Hello"), (1, "world")]


def test_recorded_source_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"provider": "p", "query": "q", "body": {"results": []}}\n\n{"provider": "p2"}\n')
    spark.dataSource.register(RecordedSource)
    rows = spark.read.format("recorded").load(str(tmp_path / "in")).collect()
    assert [(r["provider"], r["query"]) for r in rows] == [("p", "q"), ("p2", None)]
    df = spark.createDataFrame([(1, "a;b"), (2, 'c"d')], "i int, s string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(r["s"] for r in spark.read.csv(str(tmp_path / "csv"), sep=";", header=True, escape="\\").collect()) == ["a;b", 'c"d']
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_stream_drops_repeats_and_late_rows(spark, tmp_path):
    from datetime import datetime

    schema = "id long, ts timestamp, kind string"
    for k, rows in enumerate([[(1, datetime(2024, 1, 1, 5), "a"), (1, datetime(2024, 1, 1, 5), "a"), (2, datetime(2024, 1, 3, 5), "a")], [(3, datetime(2024, 1, 1, 6), "a"), (4, datetime(2024, 1, 6), "a")], [(5, datetime(2024, 1, 9), "a")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            q = windowed_activity(stream, "ts", "id", "kind").writeStream.format("memory").queryName("activity").outputMode("append").start()
        q.processAllAvailable()
    q.stop()
    assert {(str(r["day"])[:10], r["n"]) for r in spark.table("activity").collect()} >= {("2024-01-01", 1), ("2024-01-03", 1)}


def test_merge_candidates_follows_the_ordered_rule(spark):
    from difflib import SequenceMatcher

    from emberline.operators import fuzzy

    rng = random.Random(2)
    keys = []
    for g in range(8):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(10, 40)))
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(len(base))
            keys.append(base[:k] + rng.choice(["", "x", "yy"]) + base[k + 1 :])
    rng.shuffle(keys)
    kept, want = [], {}
    for i, key in enumerate(keys):
        match = next((j for j in kept if SequenceMatcher(None, key, keys[j]).ratio() > 0.86), None)
        want[i] = match
        if match is None:
            kept.append(i)
    items = spark.createDataFrame([(i, k, [f"s{i}"]) for i, k in enumerate(keys)], "id long, key string, source_ids array<string>")
    got = {r["id"]: r for r in fuzzy.merge_candidates(items, 100).collect()}
    assert {i: r["merged_into"] for i, r in got.items()} == want
    leader = kept[0]
    assert got[leader]["source_ids"] == sorted({f"s{leader}"} | {f"s{i}" for i, m in want.items() if m == leader})
    limited = {r["id"]: r["action"] for r in fuzzy.merge_candidates(items, 3).collect()}
    assert {i for i, a in limited.items() if a == "kept"} == set(kept[:3])
    found = fuzzy.best_match(items.where("id < 3"), items.select("key").where("id >= 3")).collect()
    for r in found:
        ratio = max(SequenceMatcher(None, keys[r["id"]], k).ratio() for k in keys[3:])
        assert r["represented"] == (ratio >= 0.68) and (r["best"] is None or r["best"] == ratio)
    assert fuzzy.water_fill({"a": 2, "b": 50, "c": 50, "d": 0}, 20) == {"a": 2, "b": 9, "c": 9, "d": 0}


def test_training_finds_the_signal(spark):
    from emberline.operators import training

    rng = random.Random(5)
    rows = []
    for i in range(300):
        y = int(rng.random() < 0.4)
        rows.append((i // 3, y, rng.gauss(1.5 * y, 1), None if rng.random() < 0.1 else rng.gauss(-y, 1), 1.0))
    df = spark.createDataFrame(rows, "g long, y int, a double, b double, constant double").repartition(2)
    model, auc = training.calibrated(df, ["a", "b", "constant"], "y", "g", (0.3,), 2)
    assert "constant" not in model.features and auc[0.3] > 0.8 and model.coef[0] > 0 > model.coef[1]
    scored = scoring.score(df, model)
    assert evaluation.rank_metrics(scored, F.col("y"), F.round("probability", 6)).first()["roc_auc"] > 0.8
    assert training.leaked_groups(training.folds(df, "g"), "g", "fold").count() == 0
    d = training.bootstrap_auc_difference(df.select("y", "a", (-F.col("b")).alias("b")).na.fill(0.0), "y", "a", "b", 30).first()
    assert d["low"] <= d["mean"] <= d["high"]


def test_report_values(spark):
    from emberline.functions import report

    shown = {n: one(spark, report.display_value(n, F.lit(v))) for n, v in {"papers_log_3y": 2.397895, "press_release_share_12m": 0.25, "mass_market_flag": 1.0, "paper_growth_2y": 0.5}.items()}
    assert shown == {"papers_log_3y": "10", "press_release_share_12m": "25%", "mass_market_flag": "yes", "paper_growth_2y": "0.5"}
    assert one(spark, report.field(F.create_map(F.lit("Award_Amount"), F.lit(5)), "award amount")) == 5
    best = report.best_sentence(F.array(F.lit("none"), F.lit("graphene battery for drones"), F.lit("graphene")), F.array(F.lit("graphene")), F.array(F.lit("drones")))
    assert one(spark, best) == "graphene battery for drones"
    assert one(spark, report.rescaled(F.lit(0.5), report.metric_scale([F.lit(0.5), F.lit(0.9)]))) == 50.0


def test_near_duplicates_look_at_whole_texts(spark):
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    opening, body = words("o", 5100), words("b", 12000)
    rows = [(1, opening + " " + words("x", 6000)), (2, opening + " " + words("y", 6000)), (3, words("p", 5010) + " " + body), (4, words("q", 2001) + " " + body)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["duplicate_of"] for r in dedup.near_duplicates(docs, "doc_id", "text").collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    assert [(r["later"], r["earlier"]) for r in dedup.overlap_pairs(dedup.shingled(docs, "doc_id", "text")).collect()] == [(4, 3)]


def test_overlap_pairs_against_every_pair(spark):
    import random

    from emberline.operators import dedup

    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = rng.sample(range(g * 1000, g * 1000 + 900), rng.choice([30, 60, 120]))
        for k in range(5):
            own = set(base) - set(rng.sample(base, rng.randrange(0, 16))) | {-5}  # one shingle in every text
            rows.append((g * 10 + k, f"{g}-{k}", sorted(own | {10**6 + rng.randrange(10**6) for _ in range(rng.randrange(12))})))
    rows += [(900, "tiny", [-5]), (901, "few", rows[0][2][:45])]
    df = spark.createDataFrame(rows, "id long, content_hash string, shingles array<long>")
    want = set()
    for i, _, a in rows:
        for j, _, b in rows:
            if j < i and len(a) > 40 and len(set(a) & set(b)) / max(1, min(len(a), len(b))) > 0.82:
                want.add((i, j))
    got = [(r["later"], r["earlier"]) for r in dedup.overlap_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20


def test_word_pairs_against_every_pair(spark):
    import random

    from emberline.operators import dedup

    rng = random.Random(5)
    rows = [(k, ["common", *rng.choices([f"w{i}" for i in range(40)], k=rng.randrange(0, 6))]) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, words array<string>")

    def similar(a, b, limit):
        return len(set(a) & set(b)) / len(set(a) | set(b)) > limit

    def same(a, b):
        x, y = set(a), set(b)
        both = len(x & y)
        return both / len(x | y) >= 0.5 or both in (len(x), len(y)) or bool(set(zip(a, a[1:])) & set(zip(b, b[1:])))

    pairs = [((i, a), (j, b)) for i, b in rows for j, a in rows if j < i]
    got = {(r["later"], r["earlier"]) for r in dedup.word_pairs(df, "words", dedup.same_technology(F.col("a"), F.col("b"))).collect()}
    assert got == {(i, j) for (i, a), (j, b) in pairs if same(b, a)}
    got = {(r["later"], r["earlier"]) for r in dedup.word_pairs(df, "words", dedup.jaccard(F.col("a"), F.col("b")) > 0.6, 0.6, neighbours=False).collect()}
    assert got == {(i, j) for (i, a), (j, b) in pairs if similar(a, b, 0.6)}


def test_shared_folder_is_asked_for_where_executors_are_elsewhere():
    import pytest

    from emberline.session import chosen_dir

    assert chosen_dir("hdfs://x/y/", "spark://a:1") == "hdfs://x/y" and chosen_dir(None, "local[4]").endswith("emberline-checkpoints")
    with pytest.raises(RuntimeError):
        chosen_dir(None, "spark://a:1")
