"""Queries of the patent office's answers: parts as documents whose fields are objects in some rows and arrays in others."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.base import query
from emberline.session import table
from emberline.sources import epo

AS_OF = date(1999, 6, 30)
_DATE = "date_format(date_add(DATE '1985-01-01', CAST((p_partkey * {k}) % 6000 AS INT)), 'yyyyMMdd')"


def _id(kind: str, k: int) -> str:
    return f"""concat('{{"@document-id-type":"{kind}","date":{{"$":"', {_DATE.format(k=k)}, '"}}}}')"""


# Each field in the shapes that the service gives it: an object, an array, nothing.
TITLE = """CASE p_partkey % 4 WHEN 0 THEN concat('{"@lang":"en","$":"', p_name, '"}') WHEN 1 THEN concat('[{"@lang":"de","$":"Deutsch"},{"@lang":"en","$":"', p_name, '"}]')
  WHEN 2 THEN concat('[{"@lang":"fr","$":"<b>Fran&amp;ais</b>  ', p_name, '"}]') ELSE concat('[{"@lang":"en","$":""},{"@lang":"en","$":"', p_name, '"}]') END"""
ABSTRACT = """CASE p_partkey % 3 WHEN 0 THEN '{"@lang":"en","p":{"$":"One paragraph"}}' WHEN 1 THEN '[{"@lang":"fr","p":{"$":"non"}},{"p":[{"$":"Two"},"bare"]}]' ELSE 'null' END"""
CLAIMS = f"""CASE p_partkey % 4 WHEN 0 THEN concat('{{"priority-claim":{{"document-id":', {_id('docdb', 7)}, '}}}}')
  WHEN 1 THEN concat('{{"priority-claim":[{{"document-id":[', {_id('original', 3)}, ',', {_id('epodoc', 11)}, ']}},{{"document-id":', {_id('docdb', 5)}, '}}]}}') WHEN 2 THEN '{{}}' ELSE 'null' END"""
APPLICANT = """CASE p_partkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN concat('{"applicant-name":{"name":{"$":"', p_brand, '"}}}') ELSE concat('[{"applicant-name":{"name":{"$":" ', p_brand, ' "}}},{"applicant-name":{"name":{"$":"Second"}}}]') END"""
PUBLISHED = f"CASE WHEN p_partkey % 2 = 0 THEN {_id('docdb', 13)} ELSE concat('[', '{{\"@document-id-type\":\"epodoc\"}},', {_id('docdb', 13)}, ']') END"
DOCUMENT = f"""concat('{{"@country":"EP","@doc-number":"', p_partkey, '","@kind":"A', p_size % 3, '","abstract":', {ABSTRACT}, ',"bibliographic-data":{{"invention-title":', {TITLE}, ',"publication-reference":{{"document-id":', {PUBLISHED},
  '}},"application-reference":{{"document-id":[', {_id('epodoc', 17)}, ']}},"priority-claims":', {CLAIMS}, ',"parties":{{"applicants":{{"applicant":', {APPLICANT}, '}}}}}}}}')"""
PAGE = "CASE WHEN p_partkey % 50 = 0 THEN -p_partkey ELSE p_partkey div 100 END"  # some answers hold one document, as an object

_SQL_DAY = "DATE '1985-01-01' + CAST((p_partkey * {k}) % 6000 AS INT)"
_SQL = f"""SELECT p_partkey, 'EP' || p_partkey || 'A' || (p_size % 3) AS number, CASE p_partkey % 4 WHEN 2 THEN 'Fran&ais ' || p_name WHEN 3 THEN '' ELSE p_name END AS title,
  CASE p_partkey % 3 WHEN 0 THEN 'One paragraph' WHEN 1 THEN 'Two bare' ELSE '' END AS abstract, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS assignee,
  {_SQL_DAY.format(k=13)} AS publication, CASE p_partkey % 4 WHEN 0 THEN {_SQL_DAY.format(k=7)} WHEN 1 THEN {_SQL_DAY.format(k=11)} ELSE {_SQL_DAY.format(k=17)} END AS priority FROM part"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").select(F.expr(PAGE).alias("page"), F.expr(DOCUMENT).alias("doc"))
    whole = F.when(F.col("page") < 0, F.element_at("docs", 1)).otherwise(F.concat(F.lit("["), F.array_join("docs", ","), F.lit("]")))
    pages = docs.groupBy("page").agg(F.collect_list("doc").alias("docs"))  # a hundred at most
    return pages.select(F.concat(F.lit('{"ops:world-patent-data":{"exchange-documents":{"exchange-document":'), whole, F.lit("}}}")).alias("body"))


@query(_SQL.replace("SELECT p_partkey, ", "SELECT "))
def patent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with titles, abstracts, claims and applicants as objects, as arrays and missing: the same rows from all shapes."""
    return epo.records(_bodies(spark, sf_dir))


@query(f"""WITH r AS ({_SQL}) SELECT number AS source_id, concat_ws('. ', title, nullif(abstract, ''), CASE WHEN assignee <> '' THEN 'Assignee: ' || assignee END) AS text, priority AS observed_at, nullif(assignee, '') AS company
FROM r WHERE title <> '' AND priority <= DATE '{AS_OF}' AND publication <= DATE '{AS_OF}'""")
def patent_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records known on the day, by priority and by publication."""
    return epo.references(epo.records(_bodies(spark, sf_dir)), AS_OF).select("source_id", "text", "observed_at", "company")


@query("SELECT o_orderkey // 100 AS page, count(*) AS total, count(*) FILTER (o_orderkey % 3 <> 0) AS complete, min('EP.' || o_orderkey || '.A1') FILTER (o_orderkey % 3 <> 0) AS least FROM orders GROUP BY 1")
def patent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search answers: totals and complete numbers, whether one reference came or several."""
    o = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 100").alias("page"), F.expr("""concat('{"document-id":{"country":{"$":"EP"},"doc-number":{"$":"', o_orderkey, '"},"kind":', CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '{"$":"A1"}' END, '}}')""").alias("ref"))
    pages = o.groupBy("page").agg(F.collect_list("ref").alias("refs"))  # a hundred at most
    one = F.when(F.size("refs") == 1, F.element_at("refs", 1)).otherwise(F.concat(F.lit("["), F.array_join("refs", ","), F.lit("]")))
    head = F.concat(F.lit('{"ops:world-patent-data":{"ops:biblio-search":{"@total-result-count":"'), F.size("refs"), F.lit('","ops:search-result":{"ops:publication-reference":'), one, F.lit("}}}}"))
    bodies = pages.select("page", head.alias("body"))
    return epo.found_numbers(bodies, "page").select("page", "total", F.size("numbers").cast("long").alias("complete"), F.array_min("numbers").alias("least"))
