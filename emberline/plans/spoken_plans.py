"""Queries of spoken media: pages with speakers and times, their links, and feeds made of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.base import query
from emberline.session import table
from emberline.sources import spoken

# Speaker and time before the first paragraph, which most pages leave open, and a time that isn't one before the last.
MARKED = """replace(replace(html, '<article>', '<article><cite>Ann :</cite><time>1:02:03.5</time>'), '</article>', '<time>soon</time><p>The end</p></article>')"""
LINKED = """replace(replace(html, '</head>', '<link rel="alternate" type="application/rss+xml" href="feed.xml"><track kind="captions" src="../c.bin?x=1"></head>'), '">to</a>', '">Full transcript</a><a href="/The">the transcription</a>')"""
_BLOCK = "<p>([^<]*(?:<(?:[^p/]|/[^p])[^<]*)*)</p>"


@query(f"""WITH m AS (SELECT page_id, regexp_extract_all(regexp_replace({MARKED}, '(?s)<!--.*?-->|<script.*?</script>', '', 'g'), '{_BLOCK}', 1) AS b FROM pages),
t AS (SELECT page_id, generate_subscripts(b, 1) AS k, unnest(b) AS raw FROM m),
p AS (SELECT page_id, k, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS n FROM p WHERE text <> '')
SELECT page_id, n::INTEGER AS n, CASE WHEN n = 1 AND text <> 'The end' THEN 3723.5::DOUBLE END AS seconds, CASE WHEN n = 1 THEN 'Ann ' ELSE '' END AS speaker, text, CASE WHEN n = 1 AND text <> 'The end' THEN '[01:02:03] ' ELSE '' END || CASE WHEN n = 1 THEN 'Ann : ' ELSE '' END || text AS line FROM r""")
def transcript_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of pages with the speaker and time told before them; paragraphs left open tell nothing."""
    return spoken.transcript_rows(table(spark, sf_dir, "pages").select("page_id", F.expr(MARKED).alias("html")))


@query(f"""WITH m AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*/)?', 1) AS folder, regexp_replace({LINKED}, '(?s)<!--.*?-->|<script.*?</script>', '', 'g') AS h FROM pages),
a AS (SELECT page_id, host, generate_subscripts(l, 1) AS k, unnest(l) AS link FROM (SELECT *, regexp_extract_all(h, '<a [^>]*>[^<]*</a>') AS l FROM m)),
x AS (SELECT page_id, 'feed' AS kind, 0 AS k, host || CASE WHEN folder = '' THEN '/' ELSE folder END || 'feed.xml' AS url FROM m WHERE contains(h, '</head>')
  UNION ALL SELECT page_id, 'transcript', 0, host || CASE WHEN folder = '' THEN '/' ELSE regexp_replace(folder, '[^/]+/$', '') END || 'c.bin?x=1' FROM m WHERE contains(h, '</head>')
  UNION ALL SELECT page_id, 'transcript', k, host || regexp_extract(link, 'href="([^"]*)"', 1) FROM a WHERE regexp_matches(link, '(?i){spoken.HINTS}')),
d AS (SELECT page_id, kind, url, min(k) AS k FROM x GROUP BY ALL)
SELECT page_id, kind, url, (row_number() OVER (PARTITION BY page_id, kind ORDER BY k))::INTEGER AS n FROM d QUALIFY n <= 5""")
def transcript_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption tracks, anchors that speak of a transcript, and feeds of pages, as absolute addresses."""
    return spoken.transcript_links(table(spark, sf_dir, "pages").select("page_id", "url", F.expr(LINKED).alias("html")))


PER_FEED = 40  # pages a feed, whatever the table's size


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of forty pages: titles as they stand, shortened or with more words, some items without audio and transcript."""
    c = F.col
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    own = F.when(c("page_id") % 3 == 0, title).when(c("page_id") % 3 == 1, F.concat(F.lit("Episode "), "page_id", F.lit(": "), F.substring_index(title, " ", 4))).otherwise(F.reverse(title))
    media = (
        F.when(c("page_id") % 5 == 0, F.lit("")).when(c("page_id") % 5 == 1, F.concat(F.lit('<enclosure type="audio/mpeg" url="https://a/'), "page_id", F.lit('"/>')))
        .otherwise(F.concat(F.lit('<podcast:transcript url="https://t/'), "page_id", F.lit('.html" type="text/html"/><podcast:transcript url="https://t/'), "page_id", F.lit('.vtt" type="text/vtt" language="DE" rel="captions"/>')))
    )
    item = F.concat(F.lit("<item><title><![CDATA["), own, F.lit("]]></title><guid>"), F.when(c("page_id") % 7 == 0, c("url")).otherwise(F.concat(F.lit("g"), "page_id")), F.lit("</guid><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate>"), media, F.lit("</item>"))
    rows = table(spark, sf_dir, "pages").select((c("page_id") % 100000).alias("k"), F.floor(c("page_id") / PER_FEED).alias("feed"), "page_id", item.alias("item"))
    listed = rows.groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "item"))), lambda x: x["item"]), "").alias("items"))
    return listed.select("feed", F.concat(F.lit("<rss><channel><language>de</language>"), "items", F.lit("</channel></rss>")).alias("body"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as what is sought in their feed: by title, a part of it, or address alone."""
    c = F.col
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    part = F.when(c("page_id") % 4 == 0, title).when(c("page_id") % 4 == 1, F.concat(F.substr(title, F.lit(3), F.lit(40)), F.lit("?"))).when(c("page_id") % 4 == 2, F.upper(title)).otherwise("")
    return table(spark, sf_dir, "pages").select(c("page_id").alias("target_id"), F.floor(c("page_id") / PER_FEED).alias("feed"), "url", part.alias("title"), F.lit("de").alias("language"))


@query()
def episode_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed episode that each page is about, with its transcripts in order of preference; tests compare with every pair."""
    found = spoken.episode_matches(asked(spark, sf_dir), spoken.feed_episodes(feeds(spark, sf_dir)))
    return found.select("target_id", F.round("score", 6).alias("score"), "n", "title", "url", "published", "language", "audio", F.get("transcripts", F.lit(0))["url"].alias("transcript"))
