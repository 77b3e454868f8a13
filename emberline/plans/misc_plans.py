"""Report values, annotations, fuzzy merges and training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import report, text
from emberline.operators import fuzzy, training
from emberline.operators.evaluation import confusion
from emberline.operators.scoring import score
from emberline.plans.base import query
from emberline.session import table

c = F.col


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'no data' ELSE round_even(exp(ln(1 + l_quantity)) - 1, 0)::BIGINT::VARCHAR END AS as_count, round_even(l_discount * 100, 0)::BIGINT || '%' AS as_share, CASE WHEN l_tax >= 0.5 THEN 'yes' ELSE 'no' END AS as_flag FROM lineitem")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = F.when(c("l_linenumber") != 7, F.log1p("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", report.display_value("papers_log_3y", logged).alias("as_count"), report.display_value("press_release_share_12m", c("l_discount")).alias("as_share"), report.display_value("mass_market_flag", c("l_tax")).alias("as_flag"))


@query("""SELECT p_partkey, round((0.25::DOUBLE * (p_size * 2) + 0.35::DOUBLE * (p_partkey % 101 + 0.2::DOUBLE) + 0.25::DOUBLE * 50 + 0.15::DOUBLE * (100 - p_partkey % 90)), 1) AS score,
 greatest(0.0::DOUBLE, least(100.0::DOUBLE, (p_size % 12)::DOUBLE * CASE WHEN greatest(p_size % 12, 1) <= 1 THEN 100 WHEN greatest(p_size % 12, 1) <= 10 THEN 10 ELSE 1 END)) AS metric FROM part""")
def hypothesis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"novelty": c("p_size") * 2, "impact": c("p_partkey") % 101 + F.lit(0.2), "feasibility": F.lit(50), "risk": c("p_partkey") % 90}
    m = (c("p_size") % 12).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", report.hypothesis_score(values).alias("score"), report.rescaled(m, report.metric_scale([m, F.lit(1.0)])).alias("metric"))


@query("""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9а-яё][a-z0-9а-яё+\\-]*') AS w FROM benchmark), m AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z0-9а-яё][a-z0-9а-яё+\\-]*'), lambda x: regexp_replace(x, 's+$', ''))) AS w FROM conversations)
SELECT conv_id, turn, item_id, len(list_intersect(m.w, list_distinct(list_transform(t.w, lambda x: regexp_replace(x, 's+$', ''))))) AS hits FROM m, t WHERE hits >= 2""")
def money_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share two significant words with a candidate: counted over an equi-join on words."""
    word = lambda x: F.explode(F.array_distinct(F.transform(text.tokens(c(x)), lambda w: F.regexp_replace(w, "s+$", "")))).alias("w")
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", word("text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", word("text"))
    return docs.join(items, "w").groupBy("conv_id", "turn", "item_id").agg(F.count(F.lit(1)).alias("hits")).where("hits >= 2")


@query()
def fuzzy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names with types, merged where nearly equal; the first sixty stay."""
    names = table(spark, sf_dir, "part").groupBy(text.candidate_key(F.concat_ws(" ", "p_name", "p_type")).alias("key")).agg(F.min("p_partkey").alias("id"), F.array_sort(F.collect_set(c("p_brand"))).alias("source_ids"))
    return fuzzy.merge_candidates(names.select("id", "key", "source_ids"), 60).select("id", "action", "merged_into", F.size("source_ids").alias("n_sources"))


@query()
def trained_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer fitted on labelled documents' counts, with grouped folds, calibration and a threshold, and how it does."""
    docs = table(spark, sf_dir, "documents")
    measured = docs.select("doc_id", "source", F.log1p(F.length("text").cast("double")).alias("size"), (F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s]")) / F.greatest(F.length("text"), F.lit(1))).alias("signs"), (F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.length("text"), F.lit(1))).alias("capitals"))
    rows = measured.join(table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality"), "doc_id")
    model, _ = training.calibrated(rows, ["size", "signs", "capitals"], "quality", "source", (0.3,), 2)
    return confusion(score(rows, model), c("quality"), c("probability"), model.threshold)
