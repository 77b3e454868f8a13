from emberline.functions import parameters
from pyspark.sql import functions as F


def groups(spark, text):
    return {r["label"]: (r["total"], r["examples"], r["contexts"]) for r in parameters.parameter_groups(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}


def test_units_of_both_scripts_ranges_and_acidity(spark):
    first, second = "Расход 5 г/т, крупность 45 мкм, pH 7,5;", "10-20 % извлечение"
    assert groups(spark, f"{first} {second}") == {
        "Расход реагента / дозировка": (1, "5 г/т", first),
        "Крупность / размер частиц": (1, "45 мкм", first),
        "pH / кислотность": (1, "pH 7.5", first),
        "Извлечение / выход": (1, "10-20 %", second),
    }


def test_words_are_no_units(spark):
    assert groups(spark, "we saw 3 mmol and 5 umbrellas, x5 mm, 5 mm/s and 7 ppmv") == {}
    assert groups(spark, None) == {} and groups(spark, "") == {}


def test_contexts_are_the_first_sentences(spark):
    long = "слово " * 60 + "5 мкм и 6 мкм"
    got = groups(spark, f"1 мкм. 1 мкм.\n2 мкм! {long}")["Крупность / размер частиц"]
    assert got[:2] == (5, "1 мкм|2 мкм|5 мкм|6 мкм") and got[2].split("|") == ["1 мкм.", "2 мкм!", long[:220]]
    assert groups(spark, long)["Крупность / размер частиц"][2].split("|") == [long[:220]] * 2


def test_texts_are_read_and_values_named_once(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "concat(id, ' мкм') AS text")
    plan = parameters.parameter_groups(docs)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Range (" in line for line in plan) == 1
    assert not any("RLIKE" in line for line in plan if "Filter" in line)


def test_low_signal_labels(spark):
    want = {"5 apple": False, "12 years": False, "pH 7.5": True, "5-10 %": True, "≈ 5 мм": True, "7": True, "≤ 3,5 г/т": True, "width 5": False, "5 mm wide": False, "": False}
    rows = spark.createDataFrame([(x,) for x in want], "label string").select("label", parameters.low_signal_label(F.lit("metric"), F.col("label")).alias("low"), parameters.low_signal_label(F.lit("process"), F.col("label")).alias("no"))
    got = rows.collect()
    assert {r["label"]: r["low"] for r in got} == want and not any(r["no"] for r in got)


def test_groups_are_counted_beside_their_texts(spark):
    docs = spark.range(5).selectExpr("id AS doc_id", "concat(id, ' мкм') AS text")
    plan = parameters.parameter_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_query_shuffles_numbers_and_not_texts(spark, tmp_path):
    from emberline.plans import catalogue

    spark.createDataFrame([(1, 2, 3, 4, 5.0), (1, 2, 4, 4, 5.0)], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    groups = catalogue.queries()["parameter_groups"](spark, str(tmp_path))
    plan = groups._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert plan.count("Exchange") == 1 and "concat" not in below
    assert groups.where("label = 'pH / кислотность'").select("doc_id", "total", "examples").collect() == [(12, 1, "pH 2.5")]


def test_values_are_read_as_by_columns(spark):
    raws = ["5,0 um", "5um", "7 µm", "7 μM", "3 MM", "рН 7,5", "РН7", "ph 8–9", "2 KG/t", "2 kg/t", "4 G/T", "٣ mm", "6 tph", "6 T/h", "9 °С", "9 ℃", "1-2 ppm", "10 %"]
    for near in ("yield", "доля", "влажность", "сито", "else"):
        read = dict(zip(raws, spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").orderBy("i").select(parameters.clean_value(F.col("raw")).alias("v"), parameters.parameter_label(parameters.clean_value(F.col("raw")), F.lit(near)).alias("label")).collect()))
        for raw, (value, label) in read.items():
            assert parameters._named(f"{near}: {raw} so") == (((label, value),) if label else ()), (near, raw)
