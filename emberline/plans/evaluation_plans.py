"""Agreement and classifier metrics over labels, and trends over orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.operators import evaluation as ev
from emberline.plans.base import query
from emberline.session import table

P = "(0.15 + 0.6 * quality + ((doc_id * 37) % 100) / 400.0::DOUBLE)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality is not null")


def probability() -> Column:
    return F.lit(0.15) + 0.6 * F.col("quality") + ((F.col("doc_id") * 37) % 100) / F.lit(400.0)


def noisy() -> Column:
    """A second opinion on quality."""
    return F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))


@query("""WITH p AS (SELECT quality AS a, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS b FROM labels), n AS (SELECT count(*) AS n, count_if(a = b) AS same FROM p),
e AS (SELECT sum(na * nb) AS chance FROM (SELECT a, count(*) AS na FROM p GROUP BY a) JOIN (SELECT b, count(*) AS nb FROM p GROUP BY b) ON a = b)
SELECT n, round(same / n, 6) AS observed, round(chance / (n * n), 6) AS expected, round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 6) AS kappa FROM n, e""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.cohens_kappa(rows(spark, sf_dir).withColumn("b", noisy()), "quality", "b")


@query("""WITH p AS (SELECT 1 + (doc_id + quality) % 5 AS a, 1 + (doc_id + toxic + (doc_id % 9 = 0)::INT) % 5 AS b FROM labels), n AS (SELECT count(*) AS n, sum((a - b) * (a - b)) AS d FROM p),
e AS (SELECT sum(na * nb * (a - b) * (a - b)) AS e FROM (SELECT a, count(*) AS na FROM p GROUP BY a), (SELECT b, count(*) AS nb FROM p GROUP BY b)) SELECT round(1 - (d / (n * 16)) / (e / (n * n * 16)), 6) AS weighted_kappa FROM n, e""")
def weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pairs = rows(spark, sf_dir).select(((d + F.col("quality")) % 5 + 1).cast("int").alias("a"), ((d + F.col("toxic") + (d % 9 == 0).cast("int")) % 5 + 1).cast("int").alias("b"))
    return ev.weighted_kappa(pairs, "a", "b", [1, 2, 3, 4, 5])


@query(f"""WITH p AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS y, {P} AS p FROM labels), c AS (SELECT count_if(y = 1 AND p >= 0.5) AS tp, count_if(y = 0 AND p >= 0.5) AS fp, count_if(y = 1 AND p < 0.5) AS fn, count_if(y = 0 AND p < 0.5) AS tn, round(avg((p - y) * (p - y)), 6) AS brier FROM p)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp), 6) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, brier FROM c""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(rows(spark, sf_dir), noisy(), probability(), 0.5)


@query(f"""WITH p AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS y, {P} AS s FROM labels), g AS (SELECT s, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM p GROUP BY s),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(pos + neg) OVER (ORDER BY s DESC) AS n FROM g)
SELECT round(sum(pos * (under + neg / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / n) / sum(pos), 6) AS average_precision FROM r""")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rank_metrics(rows(spark, sf_dir), noisy(), probability())


GRID = [round(0.2 + 0.01 * k, 2) for k in range(61)]


@query(f"""WITH p AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS y, {P} + 0.001 AS s FROM labels), t AS (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in GRID)}]) AS threshold),
c AS (SELECT threshold, count_if(y = 1 AND s >= threshold) AS tp, count_if(y = 0 AND s >= threshold) AS fp, count_if(y = 1) AS p FROM p, t GROUP BY threshold)
SELECT threshold, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END AS precision, round(tp / p, 6) AS recall, round(2 * tp / (tp + fp + p), 6) AS f1 FROM c""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.threshold_sweep(rows(spark, sf_dir), noisy(), probability() + 0.001, GRID)


@query("""WITH m AS (SELECT o_custkey % 50 AS tech, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) SELECT tech, CASE WHEN count(*) >= 4 THEN round(regr_slope(ln(1 + n), y), 6) END AS slope FROM m GROUP BY tech""")
def log_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("tech"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return m.groupBy("tech").agg(F.round(F.when(F.count(F.lit(1)) >= 4, F.regr_slope(F.log1p(F.col("n").cast("double")), F.col("y").cast("double"))), 6).alias("slope"))


@query("""WITH m0 AS (SELECT o_custkey % 50 AS tech, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT tech, y, n * CASE WHEN tech < 20 THEN y - 1994 ELSE 1 END AS n FROM m0),
r AS (SELECT *, row_number() OVER (PARTITION BY tech ORDER BY y) AS k, count(*) OVER (PARTITION BY tech) AS c FROM m),
h AS (SELECT tech, any_value(c) AS c, coalesce(nullif(avg(CASE WHEN k <= c // 2 THEN n END), 0), 0.5) AS early, avg(CASE WHEN k > c // 2 THEN n END) AS late FROM r GROUP BY tech)
SELECT tech, CASE WHEN c < 4 THEN NULL WHEN (late + 1) / (early + 1) >= 2.5 THEN 3 WHEN (late + 1) / (early + 1) >= 1.25 THEN 2 ELSE 1 END AS trend FROM h""")
def trend_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("tech"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    m = o.withColumn("n", F.col("n") * F.when(F.col("tech") < 20, F.col("y") - 1994).otherwise(1))
    by = Window.partitionBy("tech")
    r = m.select("*", F.row_number().over(by.orderBy("y")).alias("k"), F.count(F.lit(1)).over(by).alias("c"))
    half = F.floor(F.col("c") / 2)
    h = r.groupBy("tech").agg(F.first("c").alias("c"), F.coalesce(F.nullif(F.avg(F.when(F.col("k") <= half, F.col("n"))), F.lit(0.0)), F.lit(0.5)).alias("early"), F.avg(F.when(F.col("k") > half, F.col("n"))).alias("late"))
    ratio = (F.col("late") + 1) / (F.col("early") + 1)
    return h.select("tech", F.when(F.col("c") >= 4, F.when(ratio >= 2.5, 3).when(ratio >= 1.25, 2).otherwise(1)).alias("trend"))


@query("""WITH m AS (SELECT o_custkey AS tech, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT n, row_number() OVER (ORDER BY n) AS k, count(*) OVER () AS c FROM m)
SELECT max(CASE WHEN k = floor(0.9 * c)::INT + 1 THEN n END) AS p90, max(CASE WHEN k = floor(0.75 * c)::INT + 1 THEN n END) AS p75 FROM r""")
def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at index floor(p n) of the sorted values, found from counts by value."""
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    run = by.select("n", F.sum("c").over(Window.orderBy("n")).alias("upto"), F.sum("c").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("of"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(p * F.col("of")), F.col("n")))
    return run.agg(at(F.lit(0.9)).alias("p90"), at(F.lit(0.75)).alias("p75"))


@query("""SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS exact, round(avg((abs(a - b) <= 1)::INT), 6) AS within_one FROM (SELECT 1 + (doc_id + quality) % 5 AS a, 1 + (doc_id + toxic) % 5 AS b FROM labels)""")
def stage_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("doc_id") + F.col("quality")) % 5, (F.col("doc_id") + F.col("toxic")) % 5
    return table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((a == b).cast("int")), 6).alias("exact"), F.round(F.avg((F.abs(a - b) <= 1).cast("int")), 6).alias("within_one"))


@query("""SELECT doc_id, quality = 1 AND (1 + doc_id % 6) BETWEEN 1 AND 4 AND (1 + doc_id % 3) >= 2 AS label FROM labels""")
def label_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("doc_id") % 6 + 1).between(1, 4) & (F.col("doc_id") % 3 + 1 >= 2)).alias("label"))


@query("""WITH v AS (SELECT doc_id, unnest(['quality', 'toxic']) AS name, unnest([quality, toxic]) AS value FROM labels) SELECT name, count(value) AS filled, count(*) AS n, count(DISTINCT value) <= 1 AS constant FROM v GROUP BY name""")
def feature_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "name", "value")
    return long.groupBy("name").agg(F.count("value").alias("filled"), F.count(F.lit(1)).alias("n"), (F.count_distinct("value") <= 1).alias("constant"))


@query("""WITH p AS (SELECT CASE WHEN 1 + floor(p * 10) > 10 THEN 10 ELSE 1 + floor(p * 10) END::BIGINT AS bin FROM (SELECT """ + P + """ AS p FROM labels)) SELECT bin, count(*) AS n FROM p GROUP BY bin""")
def probability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bin_ = F.least(F.floor(probability() * 10) + 1, F.lit(10)).cast("long")
    return rows(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
