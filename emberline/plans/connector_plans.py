"""Queries of the paper, news, health and funding sources, of gates and parameter groups: driver tables as recorded responses, read back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import parameters
from emberline.operators.summaries import judge_scores
from emberline.plans.base import query
from emberline.plans.source_plans import bodies
from emberline.session import table
from emberline.sources import connectors, gated, papers

c = F.col
AS_OF = date(1999, 6, 30)


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as works: some without an abstract, a record made at the last shipment."""
    made = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("date").alias("created"))
    orders = table(spark, sf_dir, "orders").join(made, "o_orderkey", "left")
    return orders.select("o_orderkey", F.concat(F.lit("10.1/D"), "o_orderkey").alias("doi"), F.when(c("o_orderkey") % 7 != 0, F.concat(F.lit("About "), "o_orderpriority")).alias("abstract"), c("o_orderdate").cast("date").alias("published"), "created")


@query("""WITH made AS (SELECT l_orderkey, max(l_shipdate)::DATE AS created FROM lineitem GROUP BY 1)
SELECT o_orderkey FROM orders LEFT JOIN made ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> 0 AND o_orderdate::DATE BETWEEN DATE '1999-06-30' - 2190 AND DATE '1999-06-30' AND (created IS NULL OR created <= DATE '1999-06-30')""")
def works_known_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of six years with an abstract whose record existed on the date, the records read from recorded responses."""
    works = _works(spark, sf_dir)
    day = lambda part: F.date_format("published", part).cast("int")
    item = F.struct(F.upper("doi").alias("DOI"), F.array(F.lit("t")).alias("title"), F.struct(F.array(F.array(day("y"), day("M"), day("d"))).alias("date-parts")).alias("published"), F.struct(F.concat(c("created").cast("string"), F.lit("T00:00:00Z")).alias("date-time")).alias("created"))
    recorded = papers.crossref_works(bodies(works.where("created IS NOT NULL"), '{"message": {"items": %s}}', item, F.floor(c("o_orderkey") / 100)))
    return papers.known_works(works, papers.created_after(recorded, F.lit(AS_OF)), F.lit(AS_OF)).select("o_orderkey")


@query("""SELECT p_partkey, p_name AS title, DATE '1996-01-01' + (p_partkey % 1500)::INT AS observed_at FROM part
WHERE p_size % 3 <> 0 AND p_size % 5 <> 0 AND DATE '1996-01-01' + (p_partkey % 1500)::INT BETWEEN DATE '1999-06-30' - 1095 AND DATE '1999-06-30'""")
def connector_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as works with abstracts: every third too short to count, every fifth recorded after the date, others older than three years."""
    day = F.date_add(F.lit("1996-01-01").cast("date"), (c("p_partkey") % 1500).cast("int"))
    part = lambda p: F.date_format(day, p).cast("int")
    abstract = F.concat(F.lit("<p>"), F.repeat(F.lit("long abstract "), F.when(c("p_size") % 3 == 0, 2).otherwise(20)), F.lit("</p>"))
    made = F.struct(F.when(c("p_size") % 5 == 0, "1999-07-01T00:00:00Z").when(c("p_size") % 5 == 1, "1999-06-30T23:00:00Z").alias("date-time"))
    item = F.struct(F.concat(F.lit("10.2/P"), "p_partkey").alias("DOI"), F.array("p_name").alias("title"), abstract.alias("abstract"), F.struct(F.array(F.array(part("y"), part("M"), part("d"))).alias("date-parts")).alias("published"), made.alias("created"))
    pages = bodies(table(spark, sf_dir, "part"), '{"message": {"items": %s}}', item, F.floor(c("p_partkey") / 100))
    got = connectors.REGISTRY["crossref"].run(pages, AS_OF, terms=["long abstracts"]).unionByName(connectors.REGISTRY["crossref"].run(pages, AS_OF, terms=["insulin pump"]))
    return got.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("p_partkey"), "title", "observed_at")


@query("SELECT s_suppkey, s_name AS title FROM supplier")
def connector_preprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as Atom entries."""
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), "s_suppkey", F.lit("</id><published>1998-01-02T00:00:00Z</published><title>"), "s_name", F.lit("\n</title><summary>an\n abstract</summary></entry>"))
    pages = table(spark, sf_dir, "supplier").groupBy(F.floor(c("s_suppkey") / 100)).agg(F.array_join(F.collect_list(entry), "").alias("e")).select(F.concat(F.lit("<feed>"), "e", F.lit("</feed>")).alias("body"))
    got = connectors.REGISTRY["arxiv"].run(pages, AS_OF).where(c("url").startswith("https://") & (c("text") == F.concat("title", F.lit("\n\nan abstract"))))
    return got.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("s_suppkey"), "title")


@query("SELECT event_id, ts::DATE AS observed_at FROM events WHERE event_id % 5 <> 0 AND ts::DATE BETWEEN DATE '2024-01-20' - 87 AND DATE '2024-01-20' AND ts::DATE >= DATE '2024-04-06' - 88")
def connector_news_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as index articles, every fifth without a web address."""
    item = F.struct(F.concat(F.when(c("event_id") % 5 == 0, F.lit("ftp://n.example/")).otherwise(F.lit("https://n.example/")), "event_id").alias("url"), F.lit(" A  title ").alias("title"), F.date_format("ts", "yyyyMMddHHmmss").alias("seendate"))
    got = connectors.REGISTRY["gdelt"].run(bodies(table(spark, sf_dir, "events"), '{"articles": %s}', item, F.floor(c("event_id") / 100)), date(2024, 1, 20), today=date(2024, 4, 6))
    return got.where("title = 'A title'").select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("event_id"), "observed_at")


@query("SELECT page_id, url FROM pages WHERE page_id % 4 <> 0")
def connector_news_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses inside redirecting links; every fourth item is a page of the index itself."""
    target = F.when(c("page_id") % 4 == 0, F.lit("https://www.bing.com/news/apiclick?x=1")).otherwise(F.concat(F.lit("https://www.bing.com/news/apiclick.aspx?ref=r&amp;url="), F.url_encode("url"), F.lit("&amp;c=1")))
    item = F.concat(F.lit("<item><title>"), "page_id", F.lit("</title><link>"), target, F.lit("</link></item>"))
    feeds = table(spark, sf_dir, "pages").groupBy(F.floor(c("page_id") / 100)).agg(F.array_join(F.collect_list(item), "").alias("i")).select(F.concat(F.lit("<rss>"), "i", F.lit("</rss>")).alias("body"))
    return connectors.REGISTRY["bing_news"].run(feeds, AS_OF).select(c("title").cast("long").alias("page_id"), "url")


TERMS = "CASE p_size % 5 WHEN 0 THEN 'clinical ' || lower(p_name) WHEN 1 THEN 'language model ' || lower(p_name) WHEN 2 THEN 'AI ' || lower(p_name) WHEN 3 THEN 'ДИАГНОСТИКА ' || lower(p_name) ELSE lower(p_name) END"


@query(f"SELECT p_partkey, regexp_matches(t, 'clinical|диагност') AS health, regexp_matches(t, '\\b(language|model|ai)\\b') AS ml FROM (SELECT p_partkey, lower({TERMS}) AS t FROM part)")
def topic_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(F.expr(TERMS))
    return table(spark, sf_dir, "part").select("p_partkey", gated.is_health_topic(terms).alias("health"), gated.is_ml_topic(terms).alias("ml"))


@query("SELECT o_orderkey, o_orderdate::DATE AS observed_at, 'trial' AS kind FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderdate::DATE <= DATE '1999-06-30'")
def connector_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as studies, every sixth without a title; the topic passes the health gate."""
    s = F.struct
    item = s(s(s(F.concat(F.lit("NCT"), "o_orderkey").alias("nctId"), F.when(c("o_orderkey") % 6 == 0, "").otherwise("A study").alias("briefTitle")).alias("identificationModule"), s(c("o_orderstatus").alias("overallStatus"), s(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("studyFirstPostDateStruct")).alias("statusModule")).alias("protocolSection"))
    pages = bodies(table(spark, sf_dir, "orders"), '{"studies": %s}', item, F.floor(c("o_orderkey") / 100))
    got = connectors.REGISTRY["clinicaltrials"].run(pages, AS_OF, ["gene therapy"]).unionByName(connectors.REGISTRY["clinicaltrials"].run(pages, AS_OF, ["concrete"]))
    return got.select(F.regexp_extract("source_id", r"(\d+)$", 1).cast("long").alias("o_orderkey"), "observed_at", "kind")


@query("""SELECT o_orderkey % 5000 AS id, min(o_orderdate::DATE) AS observed_at, arg_min(CASE WHEN o_orderkey % 4 = 0 THEN 'tender' ELSE 'grant_call' END, (o_orderdate::DATE, CASE WHEN o_orderkey % 4 = 0 THEN 'tender' ELSE 'grant_call' END)) AS kind
FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY 1 HAVING min(o_orderdate::DATE) <= DATE '1999-06-30'""")
def connector_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls and tenders of a funding portal; a quarter is of another type, references repeat."""
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(F.array(F.lit("0")), F.array(F.lit("1"), F.lit("x")), F.array(F.lit("8")), F.array(F.lit("5"))), (c("o_orderkey") % 4 + 1).cast("int"))
    meta = F.struct(kind.alias("type"), F.array((c("o_orderkey") % 5000).cast("string")).alias("identifier"), F.array(F.lit("A call")).alias("title"), F.array(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("startDate"))
    got = connectors.REGISTRY["sedia"].run(bodies(o, '{"results": %s}', F.struct(meta.alias("metadata")), F.floor(c("o_orderkey") / 100)), AS_OF)
    return got.select(c("source_id").cast("long").alias("id"), "observed_at", "kind")


@query("""WITH a AS (SELECT 'u' || (o_orderkey % 900) AS url, o_orderkey, o_orderdate::DATE AS d, (o_orderkey % 3)::INT AS k FROM orders)
SELECT url, max(k) AS source, arg_max(d, (k, d)) AS observed_at FROM a GROUP BY url""")
def structured_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources with addresses in common: the last source's reference stays, its latest first."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("u"), c("o_orderkey") % 900).alias("url"), c("o_orderdate").cast("date").alias("observed_at"), F.lit("t").alias("title"), (c("o_orderkey") % 3).cast("int").alias("source"))
    return gated.structured_sources([o.where(c("source") == k) for k in range(3)]).select("url", "source", "observed_at")


@query("SELECT p_partkey, p_name AS title FROM part WHERE p_size % 2 = 1")
def patents_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three patent sources answers nothing, the second has rows, the third isn't asked."""
    p = table(spark, sf_dir, "part").select("p_partkey", c("p_name").alias("title"), "p_size")
    return gated.patents_chain([p.where("p_size < 0"), p.where("p_size % 2 = 1"), p]).select("p_partkey", "title")


@query("SELECT arg_min(p_partkey, (p_size, p_partkey)) AS p_partkey, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS family FROM part GROUP BY 2")
def patent_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("source_id"), c("p_name").alias("title"), F.date_add(F.lit("2000-01-01").cast("date"), c("p_size").cast("int")).alias("observed_at"))
    family = connectors.family_key(c("title"))
    return gated.family_collapse(p, family).select(c("source_id").alias("p_partkey"), family.alias("family"))


@query("SELECT page_id, contains(lower(trim(regexp_replace(url || ' ' || regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))), 'the ') AS holds FROM pages")
def phrase_in_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", papers.holds_phrase(c("url"), c("html"), ["The ", "zz no such phrase"]).alias("holds"))


SENTENCE = "'Recovery of ' || (l_quantity::INT) || ',5 % at ' || (l_linenumber + 20) || ' °C and ' || (l_suppkey % 4) || ' g/t, moisture ' || (l_partkey % 3) || '%'"


_TEXT = """concat('Расход ', l_suppkey % 9, ',', l_linenumber, ' г/т, крупность ', l_partkey % 90, ' мкм. Recovery of ', CAST(l_quantity AS INT), ',5 % at ', l_linenumber + 20, ' °C ; pH ', l_linenumber, ',5 was kept! ',
 'We saw 3 mmol and 5 umbrellas; moisture ', l_partkey % 3, '-', l_partkey % 3 + 2, ' % of feed', chr(10), chr(10), 'Производительность ', l_partkey % 40, ' т/ч, класс ', l_suppkey % 7, ' мм, частиц ', l_suppkey % 7, ' мм', CASE WHEN l_orderkey % 3 = 0 THEN ' . Again ' ELSE ' or ' END, l_suppkey % 9, ',', l_linenumber, ' g/t , x7 ppm and 8 ppm')"""
_NUM = r"\d+(?:[,.]\d+)?(?:\s*[-–—]\s*\d+(?:[,.]\d+)?)?"
_ACID, _OUT = "(?:pH|рН)", r"[^\p{L}\p{N}_/]"


@query(rf"""WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS doc_id, min({_TEXT}) AS text FROM lineitem GROUP BY 1),
p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?。;])\s+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM d),
s AS (SELECT doc_id, generate_subscripts(parts, 1) AS place, trim(regexp_replace(unnest(parts), '\s+', ' ', 'g')) AS sentence FROM p),
f AS (SELECT *, regexp_extract_all(' ' || replace(sentence, ' ', '  ') || ' ', '(?i){_OUT}((?:{_ACID}\s*)?{_NUM}\s{{0,2}}(?:{parameters.UNITS})|{_ACID}\s{{0,2}}{_NUM}){_OUT}', 1) AS found FROM s),
v AS (SELECT doc_id, place, sentence, generate_subscripts(found, 1) AS k, trim(regexp_replace(replace(unnest(found), ',', '.'), '\s+', ' ', 'g')) AS raw FROM f),
c AS (SELECT *, replace(regexp_replace(raw, '(?i)g/t', 'г/т'), 'mm', 'мм') AS value, lower(sentence) AS near FROM v),
n AS (SELECT *, CASE WHEN lower(value) LIKE '%ph%' THEN 'pH / кислотность' WHEN value LIKE '%г/т' THEN 'Расход реагента / дозировка' WHEN value LIKE '%мкм' THEN 'Крупность / размер частиц'
  WHEN value LIKE '%мм' THEN CASE WHEN regexp_matches(near, 'крупн|частиц|зерн|сито|mesh|particle|size|class') THEN 'Крупность / размер частиц' ELSE 'Размер / геометрия' END
  WHEN value LIKE '%т/ч' THEN 'Производительность / поток' WHEN value LIKE '%ppm' THEN 'Концентрация / ppm' WHEN value LIKE '%°C' THEN 'Температура'
  WHEN regexp_matches(near, 'извлеч|recovery|yield|выход') THEN 'Извлечение / выход' WHEN regexp_matches(near, 'содерж|grade|массов|доля|концентрат') THEN 'Содержание / массовая доля'
  WHEN regexp_matches(near, 'влажн|moisture') THEN 'Влажность' ELSE 'Процентный показатель' END AS label FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY n DESC, value) AS rn FROM (SELECT doc_id, label, value, count(*) AS n FROM n GROUP BY ALL)),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY place) AS rn FROM (SELECT DISTINCT doc_id, label, place, sentence FROM n))
SELECT doc_id, label, sum(n)::BIGINT AS total, string_agg(value, '|' ORDER BY rn) FILTER (rn <= 8) AS examples,
  (SELECT string_agg(sentence, '|' ORDER BY l.rn) FROM l WHERE l.doc_id = r.doc_id AND l.label = r.label AND l.rn <= 3) AS contexts FROM r GROUP BY doc_id, label""")
def parameter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as texts of several sentences in two scripts, with units, ranges, acidity and words that only look like units."""
    items = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("doc_id"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    docs = items.repartition("doc_id").groupBy("doc_id").agg(F.min(F.expr(_TEXT)).alias("text"))  # numbers are shuffled, texts made where they meet
    return parameters.parameter_groups(docs)


_LABEL = "CASE p_partkey % 11 WHEN 0 THEN concat(p_size, ',5') WHEN 1 THEN concat('pH ', p_size, '.5') WHEN 2 THEN concat(p_size, '-', p_size + 5, ' %') WHEN 3 THEN concat('≈ ', p_size, ' мм') WHEN 4 THEN concat(p_size, ' apple') WHEN 5 THEN concat(p_size, ' years') WHEN 6 THEN concat('width ', p_size) WHEN 7 THEN concat('≥ ', p_size, ' G/T') WHEN 8 THEN concat(p_size, ' – ', p_size, ',25 °С') WHEN 9 THEN concat(' рН', p_size) ELSE concat(p_size, ' mm wide') END"


@query(rf"""SELECT p_partkey, p_size % 5 > 0 AND regexp_full_match(replace(trim({_LABEL}), ',', '.'), '(?i)\s*(?:[~≈<>≤≥±]\s*)?(?:{_ACID}\s*)?{_NUM}(?:\s?(?:{parameters.UNITS}))?\s*') AS low FROM part""")
def low_signal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes: numbers, ranges, acidity and signs against words that follow a number."""
    p = spark.sql(f"SELECT p_partkey, {_LABEL} AS label, CASE WHEN p_size % 5 > 0 THEN ' Metric' ELSE 'Process' END AS kind FROM {{part}}", part=table(spark, sf_dir, "part"))
    return p.select("p_partkey", parameters.low_signal_label(c("kind"), c("label")).alias("low"))


@query("""WITH r AS (SELECT l_orderkey AS id, 'm' || l_linenumber AS model, (l_partkey % 5)::INT AS events, (l_partkey % 5 - l_partkey % 2 * (l_partkey % 5 > 0)::INT)::INT AS ok, (l_suppkey % 3)::INT AS missed, (l_quantity % 11)::DOUBLE AS overall FROM lineitem),
b AS (SELECT *, overall = max(overall) OVER (PARTITION BY id) AS best FROM r), w AS (SELECT *, CASE WHEN best THEN 1.0 / sum(best::INT) OVER (PARTITION BY id) ELSE 0 END AS win FROM b)
SELECT model, count(*) AS judged, round(sum(ok) / greatest(sum(events), 1), 3) AS event_precision, round(sum(ok) / greatest(sum(ok) + sum(missed), 1), 3) AS event_recall, round(avg(overall), 2) AS mean_overall,
round(sum(win) / (SELECT count(DISTINCT id) FROM r), 3) AS win_share FROM w GROUP BY model""")
def judge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as judged extractions: models by line number."""
    li = table(spark, sf_dir, "lineitem")
    events = (c("l_partkey") % 5).cast("int")
    ok = events - F.when(events > 0, c("l_partkey") % 2).otherwise(0)
    rows = li.select(c("l_orderkey").alias("id"), F.concat(F.lit("m"), "l_linenumber").alias("model"), events.alias("events"), ok.alias("ok"), (c("l_suppkey") % 3).cast("int").alias("missed"), (c("l_quantity") % 11).cast("double").alias("overall"))
    return judge_scores(rows)
