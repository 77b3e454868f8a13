"""Queries of labels as of a past date and of pools over two runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import pool
from emberline.plans.base import query
from emberline.session import table

AS_OF, TODAY = date(2020, 6, 30), date(2024, 6, 30)
FACTS = """SELECT p_partkey AS id, p_name AS title, p_partkey % 4 AS n_articles, 1 + p_size % 5 AS stage, p_type AS stage_quote, CASE WHEN p_partkey % 3 = 0 THEN 1 + p_size % 6 END AS wiki_stage,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 15 AS DOUBLE) END AS wiki_age, CASE WHEN p_partkey % 3 = 0 THEN '2019-05-06T07:08:09Z' END AS wiki_revision, CASE p_partkey % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN '1800' ELSE CAST(2000 + p_size % 30 AS STRING) END AS established FROM part"""


@query(f"""WITH f AS ({FACTS.replace('STRING', 'VARCHAR')}), y AS (SELECT *, CASE WHEN try_cast(established AS INT) BETWEEN 1900 AND 2024 THEN try_cast(established AS INT) END AS since FROM f),
w AS (SELECT *, CASE WHEN stage = 5 THEN 'articles' WHEN wiki_stage = 5 THEN 'encyclopaedia of 2019-05-06' WHEN wiki_age > 7 THEN 'its article is ' || wiki_age::INT || ' years old' WHEN 2020 - since > 7 THEN 'known since ' || since END AS why FROM y)
SELECT id, CASE WHEN n_articles > 0 THEN (why IS NULL)::INT::VARCHAR END AS label, CASE WHEN n_articles > 0 THEN CASE WHEN why IS NULL THEN '' ELSE 'N1_mature_at_T' END END AS negative_type, CASE WHEN n_articles = 0 THEN 'drop' ELSE 'keep' END AS decision,
  CASE WHEN n_articles = 0 THEN 'no documents on the day' WHEN why IS NULL THEN 'stage ' || stage || ': ' || p_type ELSE 'mature then (' || why || ')' END AS reason FROM w JOIN part ON p_partkey = id""")
def retro_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates judged as of a past day by articles, an encyclopaedia and the year they were known from."""
    return pool.retro_labels(spark.sql(FACTS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part")), AS_OF, TODAY)


@query("""WITH old AS (SELECT c_custkey AS id, c_mktsegment AS domain, CASE WHEN c_custkey % 3 = 0 THEN 'ann' ELSE '' END AS assigned_to, CASE WHEN c_custkey % 6 = 0 THEN 'done' ELSE 'new' END AS status FROM customer WHERE c_custkey % 4 <> 0),
run AS (SELECT c_custkey AS id, c_mktsegment AS domain FROM customer WHERE c_custkey % 5 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT * FROM old WHERE domain NOT IN ('BUILDING', 'MACHINERY') UNION ALL
SELECT r.id, r.domain, coalesce(o.assigned_to, ''), coalesce(o.status, 'new') FROM run r LEFT JOIN old o ON o.id = r.id""")
def pool_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a pool and a run over two of its domains, made twice: assignments and status stay."""
    c = F.col
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("domain"))
    old = rows.where("id % 4 <> 0").select("*", F.when(c("id") % 3 == 0, "ann").otherwise("").alias("assigned_to"), F.when(c("id") % 6 == 0, "done").otherwise("new").alias("status"))
    touched = ["BUILDING", "MACHINERY"]
    run = rows.where((c("id") % 5 != 0) & c("domain").isin(touched)).select("*", F.lit("").alias("assigned_to"), F.lit("new").alias("status"))
    return pool.merge_pool(pool.merge_pool(old, run, touched), run, touched)
