"""Source, sink and report queries: driver tables written as recorded responses and read back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.text import strip_html
from emberline.plans.base import query
from emberline.session import table
from emberline.sources import connectors, sinks

c = F.col


def bodies(rows: DataFrame, wrap: str, item, per) -> DataFrame:
    """Items as JSON responses, grouped by per: wrap has %s where the array goes."""
    head, tail = wrap.split("%s")
    listed = rows.select(per.alias("page"), item.alias("i")).groupBy("page").agg(F.to_json(F.collect_list("i")).alias("a"))
    return listed.select(F.concat(F.lit(head), "a", F.lit(tail)).alias("body"))


@query("SELECT 'https://www.usaspending.gov/award/g' || o_orderkey AS url, 'A' || o_orderkey AS source_id, o_orderdate::DATE AS observed_at, o_totalprice AS amount, 'R' || o_custkey AS company, 'money' AS channel FROM orders WHERE o_orderdate::DATE <= DATE '2000-12-31'")
def connector_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(
        F.concat(F.lit("A"), "o_orderkey").alias("Award ID"), F.concat(F.lit("R"), "o_custkey").alias("Recipient Name"), c("o_totalprice").alias("Award Amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Start Date"),
        F.lit("d").alias("Description"), F.lit("g").alias("Awarding Agency"), F.concat(F.lit("g"), "o_orderkey").alias("generated_internal_id"),
    )
    found = bodies(table(spark, sf_dir, "orders"), '{"results": %s}', item, F.floor(c("o_orderkey") / 100))
    return connectors.REGISTRY["usaspending"].run(found, date(2000, 12, 31)).select("url", "source_id", "observed_at", "amount", "company", "channel")


@query("SELECT p_partkey % 300 AS id, max(p_retailprice) AS amount FROM part GROUP BY 1")
def connector_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest amount of each project."""
    v = lambda x: F.struct(x.cast("string").alias("value"))
    item = F.struct(v(c("p_partkey") % 300).alias("project_id"), v(c("p_name")).alias("title"), v(c("p_type")).alias("abstract"), v(F.lit("2001-02-03")).alias("start_date"), v(c("p_retailprice")).alias("funding_amount"))
    found = bodies(table(spark, sf_dir, "part"), '{"results": {"bindings": %s}}', item, F.floor(c("p_partkey") / 100))
    return connectors.REGISTRY["cordis"].run(found, date(2001, 6, 30)).select(c("source_id").cast("long").alias("id"), "amount")


@query("SELECT event_id, ts::DATE AS observed_at FROM events WHERE ts::DATE <= DATE '2024-01-20'")
def connector_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feed items, read back with their dates."""
    item = F.concat(F.lit("<item><title>t"), "event_id", F.lit("</title><link>https://x.example/"), "event_id", F.lit("</link><pubDate>Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><description><![CDATA[a <b>b</b>]]></description></item>"))
    pages = table(spark, sf_dir, "events").groupBy(c("user_id")).agg(F.array_join(F.collect_list(item), "").alias("i")).select(F.concat(F.lit("<rss><channel>"), "i", F.lit("</channel></rss>")).alias("body"))
    got = connectors.REGISTRY["rss"].run(pages, date(2024, 1, 20))
    return got.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("event_id"), "observed_at")


@query("SELECT item_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS body FROM benchmark")
def text_from_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as inverted indexes, and back."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).alias("p", "w"))
    index = words.groupBy("item_id", "w").agg(F.collect_list("p").alias("at")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return index.select("item_id", connectors.text_from_index(c("index")).alias("body"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def sink_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    old, new = (sinks.latest(e.where(c("event_id") % 2 == k), ["user_id"], c("event_id")) for k in (0, 1))
    both = sinks.latest(old.unionByName(new), ["user_id"], c("event_id"))
    return sinks.upsert(old, both, ["user_id"])


@query("SELECT n_regionkey, '# R' || n_regionkey || chr(10) || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS report FROM nation GROUP BY n_regionkey")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").withColumn("t", F.concat(F.lit("R"), "n_regionkey"))
    return sinks.markdown(rows, "n_regionkey", "t", c("n_name"), "n_name")


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'))) >= 150 AS readable FROM pages")
def readable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", (F.length(F.trim(bare)) >= 150).alias("readable"))


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", strip_html(c("html")).alias("text"))
