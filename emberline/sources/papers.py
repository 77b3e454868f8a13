"""Papers and news over recorded responses: late records, phrases in works, and the connectors of open indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import dates
from emberline.functions.text import strip_html
from emberline.sources.connectors import V, about, items, refs, register

WORKS = "message struct<items:array<struct<DOI:string,title:array<string>,abstract:string,language:string,type:string,`is-referenced-by-count`:int,published:struct<`date-parts`:array<array<int>>>,created:struct<`date-time`:string>>>>"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def part_date(parts: Column, month: int, day: int) -> Column:
    """A date from [year, month, day] with stand-ins for what is missing; NULL without a year."""
    own = F.get(parts, F.lit(0))
    return F.make_date(F.get(own, F.lit(0)), F.coalesce(F.get(own, F.lit(1)), F.lit(month)), F.coalesce(F.get(own, F.lit(2)), F.lit(day)))


def crossref_works(bodies: DataFrame) -> DataFrame:
    """doi, title, abstract (bare), published (July 1 where only the year is known), citations, preprint, created."""
    rows = items(bodies, WORKS, "message.items")
    return rows.select(
        F.lower(V["DOI"]).alias("doi"), squeeze(F.array_join(V["title"], " ")).alias("title"), squeeze(F.regexp_replace(V["abstract"], "<[^>]+>", " ")).alias("abstract"), V["language"].alias("language"),
        part_date(V["published"]["date-parts"], 7, 1).alias("published"), F.coalesce(V["is-referenced-by-count"], F.lit(0)).alias("citations"), (V["type"] == "posted-content").alias("preprint"), dates.date_prefix(V["created"]["date-time"]).alias("created"),
    )


def created_after(works: DataFrame, as_of: Column) -> DataFrame:
    """Distinct dois (lower case) whose record was made after the evaluation date: they were not known then, whatever their issue's date."""
    return works.where(F.col("doi").isNotNull() & (F.col("created") > as_of)).select("doi").distinct()


def known_works(works: DataFrame, late: DataFrame, as_of: Column, years: int = 6) -> DataFrame:
    """Works (doi, abstract, published) of the years before the evaluation date that have an abstract and no late record; works without a doi stay."""
    inside = F.col("published").between(F.date_sub(as_of, 365 * years), as_of)
    timely = works.where(inside & (F.length(F.coalesce("abstract", F.lit(""))) > 0))
    return timely.withColumn("__doi", F.lower("doi")).join(late.select(F.lower("doi").alias("__doi")).distinct(), "__doi", "left_anti").drop("__doi")


def holds_phrase(title: Column, abstract: Column, phrases: list[str]) -> Column:
    """Any of the phrases stands in title and abstract, case and white space aside."""
    text = F.lower(squeeze(F.concat_ws(" ", title, F.regexp_replace(F.coalesce(abstract, F.lit("")), "<[^>]+>", " "))))
    return F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(text, p))


@register("crossref", "science", "strict", look_back=1095, fits=lambda terms: about("title", "text")([" ".join(t for t in terms)] if terms else []))
def crossref(bodies: DataFrame) -> DataFrame:
    """Works of three years with an abstract of over 150 characters; a date of year and month only is its first day. A record made after the evaluation date, as those of back issues are, wasn't there then."""
    rows = items(bodies, WORKS, "message.items")
    title, abstract = squeeze(F.array_join(V["title"], " ")), squeeze(F.regexp_replace(V["abstract"], "<[^>]+>", " "))
    good = rows.where(V["DOI"].isNotNull() & (F.length(title) > 0) & (F.length(abstract) > 150))
    return refs(good, url=F.concat(F.lit("https://doi.org/"), V["DOI"]), title=title, observed_at=part_date(V["published"]["date-parts"], 1, 1), text=F.concat(title, F.lit("\n\n"), abstract), source_id=F.lower(V["DOI"]), recorded_at=dates.date_prefix(V["created"]["date-time"]))


def blocks(bodies: DataFrame, name: str) -> DataFrame:
    """One row for each <name> element of XML bodies, column i."""
    return bodies.select(F.explode(F.regexp_extract_all("body", F.lit(rf"(?s)<{name}\b[^>]*>(.*?)</{name}>"), F.lit(1))).alias("i"))


def tag(name: str) -> Column:
    raw = F.regexp_replace(F.regexp_extract("i", rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")
    return F.nullif(F.trim(raw), F.lit(""))


@register("arxiv", "science", "strict", look_back=730)
def arxiv(bodies: DataFrame) -> DataFrame:
    """Atom entries with an abstract."""
    rows = blocks(bodies, "entry")
    good = rows.where(tag("id").isNotNull() & tag("summary").isNotNull())
    url = F.replace(tag("id"), F.lit("http://"), F.lit("https://"))
    title, abstract = squeeze(strip_html(tag("title"))), squeeze(strip_html(tag("summary")))
    return refs(good, url=url, title=title, observed_at=dates.date_prefix(tag("published")), text=F.concat(title, F.lit("\n\n"), abstract), source_id=url)


@register("gdelt", "market", "post", historical=False, keeps=88)
def gdelt(bodies: DataFrame) -> DataFrame:
    """Articles with a web address and a title; the day of a fourteen-digit time."""
    rows = items(bodies, "articles array<struct<url:string,title:string,seendate:string,language:string,sourcecountry:string>>", "articles")
    title = squeeze(V["title"])
    day = F.when(V["seendate"].rlike(r"^\d{14}$"), F.try_to_date(F.substr(V["seendate"], F.lit(1), F.lit(8)), "yyyyMMdd"))
    return refs(rows.where(V["url"].rlike("^https?://") & (F.length(title) > 0)), url=V["url"], title=title, observed_at=day, source_id=V["url"])


@register("bing_news", "market", "none", historical=False)
def bing_news(bodies: DataFrame) -> DataFrame:
    """Feed items by the address inside the redirecting link; the index's own pages go."""
    link = F.replace(tag("link"), F.lit("&amp;"), F.lit("&"))
    inner = F.try_url_decode(F.nullif(F.regexp_extract(link, r"[?&]url=([^&#]*)", 1), F.lit("")))
    rows = blocks(bodies, "item").select("i", F.coalesce(inner, link).alias("target"))
    host = F.regexp_extract("target", r"^https?://([^/?#]*)", 1)
    return refs(rows.where(F.col("target").startswith("http") & ~F.contains(host, F.lit("bing.com"))), url=F.col("target"), title=strip_html(tag("title")), source_id=F.col("target"))


@register("habr", "market", "post")
def habr(bodies: DataFrame) -> DataFrame:
    """Feed items that are articles or company posts, without their address's query."""
    rows = blocks(bodies, "item").select("i", F.substring_index(tag("link"), "?", 1).alias("link"))
    return refs(rows.where(F.col("link").rlike("/articles/|/companies/")), url=F.col("link"), title=strip_html(tag("title")), observed_at=dates.rss_date(tag("pubDate")), source_id=F.col("link"))
