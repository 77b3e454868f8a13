"""Queries of catalogue sheets, printed page numbers, nested validation and group holdouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import validation
from emberline.plans.base import query
from emberline.session import table
from emberline.sources import catalog

c = F.col

# Two orders of columns: every other sheet has a second header half-way that turns to the other one.
_HEAD = ("№,Область,Технология (слабый сигнал),Источники,Балл (стадия+тренд)", "Источники,,№,Технология (слабый сигнал),Компании")
_ROWS = (
    "concat(p_partkey, CASE WHEN p_partkey % 9 = 0 THEN ' a' ELSE '' END, ',\"', p_brand, ', \"\"x\"\"\",', p_name, ',[one](https://a/', p_partkey, ') and [b](http://b),', p_size)",
    "concat('\"[t](https://c/', p_partkey, ')', chr(10), 'next line\",,', p_partkey, ',', p_name, ',', p_type)",
)
PER_SHEET = 50


@query(f"""WITH p AS (SELECT *, p_partkey // {PER_SHEET} AS sheet, p_partkey % {PER_SHEET} AS k, ((p_partkey // {PER_SHEET}) % 2 = 1 AND p_partkey % {PER_SHEET} >= 25) AS other FROM part)
SELECT p_partkey AS id, sheet::BIGINT AS sheet, p_name AS title, CASE WHEN other THEN NULL ELSE p_brand || ', "x"' END AS domain, CASE WHEN other THEN p_type END AS companies, CASE WHEN other THEN NULL ELSE p_size::VARCHAR END AS reference_score,
  CASE WHEN other THEN 't https://c/' || p_partkey ELSE 'one https://a/' || p_partkey || '|b http://b' END AS links
FROM p WHERE other OR p_partkey % 9 <> 0""")
def catalogue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as CSV sheets with rubbish above the header, headers in two orders, quoted cells over two lines and rows without a number."""
    p = table(spark, sf_dir, "part").select(F.expr(f"p_partkey div {PER_SHEET}").alias("sheet"), (c("p_partkey") % PER_SHEET).alias("k"), F.expr(_ROWS[0]).alias("one"), F.expr(_ROWS[1]).alias("two"))
    turned = (c("sheet") % 2 == 1) & (c("k") >= 25)
    line = F.struct("k", F.concat(F.when((c("sheet") % 2 == 1) & (c("k") == 25), F.lit(_HEAD[1] + "\n")).otherwise(""), F.when(turned, c("two")).otherwise(c("one"))).alias("line"))
    body = F.concat(F.lit("﻿notes,№ 7\n\n" + _HEAD[0] + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"))
    found = catalog.catalogue(catalog.grid(p.groupBy("sheet").agg(body.alias("body"))))
    return found.select("id", "sheet", "title", "domain", "companies", "reference_score", F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["title"], x["url"])), "|").alias("links"))


_PAGE = "CASE turn % 3 WHEN 0 THEN concat(' ', turn + 1 - CASE WHEN turn % 5 = 4 THEN 9 ELSE 3 END, ' ', chr(10), coalesce(text, '')) WHEN 1 THEN concat('head', chr(10), replace(coalesce(text, ''), chr(10), ' '), chr(10), 40 + turn, chr(10)) ELSE replace(coalesce(text, ''), chr(10), ' ') END"


@query(f"""WITH p AS (SELECT conv_id AS doc_id, turn AS page, {_PAGE} AS t FROM conversations),
l AS (SELECT *, string_split(CASE WHEN right(t, 1) = chr(10) THEN t[:-2] ELSE t END, chr(10)) AS lines FROM p),
o AS (SELECT doc_id, page, try_cast(trim(list_filter(lines[:3] || lines[-3:], lambda x: regexp_full_match(x, '\\s*\\d{{1,3}}\\s*'))[1]) AS INTEGER) AS own FROM l),
n AS (SELECT doc_id, page + 1 - own AS off, count(*) AS n FROM o WHERE own IS NOT NULL GROUP BY ALL),
m AS (SELECT doc_id, off FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, off) = 1)
SELECT o.doc_id, page, coalesce(own, page + 1 - coalesce(off, 0))::INTEGER AS printed FROM o LEFT JOIN m ON m.doc_id = o.doc_id""")
def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages, with a number above, below or none."""
    return catalog.printed_numbers(table(spark, sf_dir, "conversations").select(c("conv_id").alias("doc_id"), c("turn").alias("page"), F.expr(_PAGE).alias("text")))


FEATURES = ["acctbal", "orders", "spent", "late", "nothing"]


def labelled(spark: SparkSession, sf_dir: str, most: int = 1000) -> DataFrame:
    """Customers as labelled technologies: at most `most`, a bounded sample by hash; groups of up to four, two kinds of label noise."""
    o = table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"), F.avg((c("o_orderstatus") == "F").cast("int")).alias("late"))
    rows = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    label = ((c("c_acctbal") + F.pmod(F.xxhash64("c_custkey"), F.lit(6000)) > 5500) | (F.coalesce("orders", F.lit(0)) > 14)).cast("int")
    rows = rows.select(c("c_custkey").alias("id"), c("c_acctbal").alias("acctbal"), "orders", "spent", "late", F.lit(None).cast("double").alias("nothing"), label.alias("label"), F.expr("concat('g', c_custkey div 4)").alias("grp"), c("c_mktsegment").alias("kind"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)


@query()
def nested_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers scored by models that have seen no row of their group, c chosen inside; tests repeat it in plain loops."""
    got = validation.nested_cv(labelled(spark, sf_dir), "id", FEATURES, "label", "grp", (0.01, 0.1, 1.0))
    return got.select("id", "y", "grp", "fold", "best_c", F.round("probability", 6).alias("probability"))


QUOTAS = {"BUILDING": 4, "MACHINERY": 6, "AUTOMOBILE": 3}


def _taken(k: int, kind: str, quota: int) -> str:
    before = " ".join(f"AND grp NOT IN (SELECT grp FROM t{j})" for j in range(k))
    return f"t{k} AS (SELECT min_by(id, h) AS id, grp, '{kind}' AS kind FROM r WHERE kind = '{kind}' {before} GROUP BY grp ORDER BY min(h) LIMIT {quota})"


@query(
    "WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'g' || (c_custkey % 60) END AS grp, c_mktsegment AS kind, sha256('7|' || c_custkey) AS h FROM customer WHERE c_custkey % 10 <> 0), "
    + ", ".join(_taken(k, kind, quota) for k, (kind, quota) in enumerate(QUOTAS.items()))
    + " SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2"
)
def group_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers held out by quotas of segments, each of a group of its own."""
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), F.when(c("c_custkey") % 10 == 0, "").otherwise(F.concat(F.lit("g"), c("c_custkey") % 60)).alias("grp"), c("c_mktsegment").alias("kind"))
    return validation.group_holdout(rows, "id", "grp", "kind", QUOTAS, 7)
