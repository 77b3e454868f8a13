"""Queries of the response store and of feeds paged back to a date."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.base import query
from emberline.session import shared_dir, table
from emberline.sources import store

c = F.col
CUTOFF = date(2024, 1, 12)
FEEDS = "SELECT event_id, user_id % 60 AS feed, 1 + CAST(event_id % 4001 AS INT) % 23 AS page, CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('u', event_id % 1009 % (40 + 3 * (event_id % 4001 % 23))) END AS url, CASE WHEN event_id % 13 <> 0 THEN CAST(ts AS DATE) + CAST(20 - event_id % 4001 % 23 AS INT) END AS published FROM events"


@query(f"""WITH i AS ({FEEDS}), f AS (SELECT feed, url, min(page) AS fp FROM i WHERE url <> '' GROUP BY ALL),
p AS (SELECT feed, page, min(published) AS oldest, (SELECT count(*) FROM f WHERE f.feed = i.feed AND f.fp = i.page) AS gain FROM i GROUP BY feed, page),
k AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY page) AS rn FROM p),
s AS (SELECT feed, coalesce(min(CASE WHEN page <> rn OR gain = 0 THEN rn - 1 WHEN oldest < DATE '{CUTOFF}' THEN rn END), max(rn)) AS stop FROM k GROUP BY feed)
SELECT i.event_id, i.feed, i.page, i.url FROM i JOIN s ON s.feed = i.feed AND i.page <= s.stop JOIN f ON f.feed = i.feed AND f.url = i.url AND f.fp = i.page WHERE i.published IS NULL OR i.published >= DATE '{CUTOFF}'""")
def feed_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feed items over pages: some pages missing, some with nothing new, dates further back page by page."""
    items = spark.sql(FEEDS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return store.paged_back(items, CUTOFF).select("event_id", "feed", "page", "url")


@query("""WITH r AS (SELECT 's' || (o_orderkey % 3) AS source, 'q' || (o_orderkey % 5000) AS request, o_orderpriority AS body, o_orderkey % 4 > 0 AS ok, o_orderkey % 2 AS run FROM orders),
one AS (SELECT source, request, min(body) AS body FROM r WHERE ok AND run = 0 GROUP BY ALL), two AS (SELECT source, request, min(body) AS body FROM r WHERE ok AND run = 1 GROUP BY ALL)
SELECT * FROM one UNION ALL SELECT * FROM two WHERE (source, request) NOT IN (SELECT (source, request) FROM one)""")
def response_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as responses in two runs, the first of them repeated: only successes enter, an answer that is there stays."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("s"), c("o_orderkey") % 3).alias("source"), F.concat(F.lit("q"), c("o_orderkey") % 5000).alias("request"), F.when(c("o_orderkey") % 4 > 0, 200).otherwise(503).alias("status"), c("o_orderpriority").alias("body"), (c("o_orderkey") % 2).alias("run"))
    path, now = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/responses-{uuid.uuid4().hex}", datetime(2024, 1, 2)
    for run, day in ((0, 0), (0, 1), (1, 2)):
        store.remember(rows.where(c("run") == run), path, now + timedelta(days=day))
    return store.fresh(spark, path, now + timedelta(days=2)).select("source", "request", "body")
