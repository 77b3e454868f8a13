import random

import corpus_pipeline as pipeline
from emberline.llm import decontam, neardup
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_packing import check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"aa": ["lorka", "temri", "vosna", "klept"], "bb": ["ñuez", "ciónar", "osll", "jaque"]}


def corpus(seed=3):
    rng = random.Random(seed)

    def prose(lang, n):
        return ["".join(rng.choices(WORDS[lang], k=rng.randrange(2, 6))) for _ in range(n)]

    items = [(k, " ".join(prose("aa", 25))) for k in range(4)]
    rows = []
    for i in range(120):
        lang = rng.choice(list(WORDS))
        text = prose(lang, 90)
        if i % 10 == 0:
            text = "\n".join(["Shared footer line of many documents", " ".join(text)]).split(" ")
        if i % 12 == 5:
            text = [*text[:40], *items[i % 4][1].split(" "), *text[40:]]
        rows.append((i, " ".join(text), lang))
    rows += [(200, rows[3][1], "aa"), (201, rows[4][1] + " tail", "bb"), (202, "12 34 ... !!", "aa"), (203, None, None), (204, "", "bb")]
    rows += [(205, rows[8][1], "aa"), (206, " ".join("lorkax" if k == 40 else w for k, w in enumerate(rows[8][1].split(" "))), "aa")]
    return [(i, t, lang, f"s{i % 3}", len(t) if t is not None else None) for i, t, lang in rows], items


def close(a, b):
    from tests.llm.test_neardup import at_least, shingle_set

    return at_least(shingle_set(a), shingle_set(b))


def test_each_stage_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = {r["doc_id"]: r for r in docs.collect()}
        after = {i: r["text"] for i, r in out.items()}
        if name == "language_id":
            assert set(before) - set(after) == {202, 203, 204}
        if name == "line_dedup":
            want = brute_lines(list(before.items()))
            import hashlib

            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after.items()} == {i: w[2] for i, w in want.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in out.values()) and sum(w[1] for w in want.values()) >= 10
        if name == "near_dedup":
            gone = set(before) - set(after)
            assert {200, 201, 205, 206} <= gone and all(any(j < i and close(before[i], before[j]) for j in before) for i in gone)
            assert not [(i, j) for i in after for j in after if j < i and close(after[i], after[j])]
        if name == "decontamination":
            assert set(before) - set(after) == {i for i, _ in brute_leaks(list(before.items()), items)} and len(before) - len(after) >= 8
        before = after
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert check(list(before.items()), packed, 1024) < 0.3  # rests of about 750 ids each leave no room for a second
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_filters_keep_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "lorka temri", "aa", "s", 1), (1, "lorka temri", "aa", "s", 1), (2, "lorka temri", "aa", "s", 1)], SCHEMA)
    assert sorted((r["doc_id"] or -1) for r in neardup.keep_one_of_each(docs).collect()) == [-1, 1]


def test_filters_keep_columns_of_any_name(spark):
    """Extra columns named as helpers are, or as fields of the operators' rows, come through unchanged."""
    extra = ["__id", "__bitmap", "gone_id", "changed_id", "keep_map", "component_id", "n_dropped", "key", "__node"]
    rows, items = corpus()
    docs = spark.createDataFrame([(*r, *range(r[0], r[0] + len(extra))) for r in rows], SCHEMA + "".join(f", {c} long" for c in extra)).repartition(3)
    for stage in (pipeline.line_dedup, pipeline.near_dedup):
        got = stage(spark, docs, "").collect()
        assert got and got[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
        assert all(r[c] == r["doc_id"] + k for r in got for k, c in enumerate(extra))
    leaks = decontam.drop_contaminated(docs, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, h long")).collect()
    assert 0 < len(leaks) < len(rows) and all(r["__id"] == r["doc_id"] for r in leaks)
