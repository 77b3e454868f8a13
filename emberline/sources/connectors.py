"""Connectors: recorded responses of public sources, parsed to one reference schema.

A connector reads a DataFrame of recorded bodies (one response a row, column body) and returns references: url,
title, observed_at, text, source_id, kind, amount, currency, company, customer. run() applies the evaluation date: a
dated reference after it goes, an undated one stays unless the connector's dates are strict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import dates, money
from emberline.functions.text import key_stems, relevant, stems, strip_html

COLUMNS = {
    "url": "string", "title": "string", "observed_at": "date", "text": "string", "source_id": "string", "kind": "string", "amount": "double", "currency": "string", "company": "string", "customer": "string", "recorded_at": "date",
}


@dataclass(frozen=True)
class Connector:
    name: str
    channel: str  # science, money, market or adoption
    date_support: str  # strict, post or none
    parse: Callable[[DataFrame], DataFrame]
    default_on: bool = True
    historical: bool = True
    gate: Callable[[Column], Column] | None = None  # of the array of terms: whether the source is asked at all
    look_back: int | None = None  # days before the evaluation date
    keeps: int | None = None  # days before today that the index holds
    fits: Callable[[list[str]], Column] | None = None  # over the references: whether one belongs to the terms

    def __post_init__(self):
        if self.channel not in ("science", "money", "market", "adoption") or self.date_support not in ("strict", "post", "none"):
            raise ValueError(f"{self.name}: unknown channel or date support")

    def run(self, bodies: DataFrame, as_of: date, terms: list[str] | None = None, today: date | None = None) -> DataFrame:
        """The references known on the day; with terms also only those of their topic, none where the source isn't asked for it.

        today (the day of the run) matters to sources that keep a limited time alone. Undated references pass windows unless
        dates are strict.
        """
        refs = self.parse(bodies)
        day = F.col("observed_at")
        first, last = as_of - timedelta(days=self.look_back) if self.look_back else None, as_of
        if self.keeps is not None and today is not None:
            oldest, last = today - timedelta(days=self.keeps), min(as_of, today)
            first = max(last - timedelta(days=self.keeps - 1), oldest)
            refs = refs.where(F.lit(last >= oldest))
        inside = (day <= F.lit(last)) & (F.lit(True) if first is None else day >= F.lit(first))
        ok = F.lit(True) if self.date_support == "none" else day.isNotNull() & inside if self.date_support == "strict" else day.isNull() | inside
        ok = ok & (F.col("recorded_at").isNull() | (F.col("recorded_at") <= F.lit(as_of)))
        if terms is not None:
            if self.gate is not None:
                ok = ok & self.gate(F.array(*map(F.lit, terms)).cast("array<string>"))
            if self.fits is not None:
                ok = ok & self.fits(terms)
        return refs.where(ok).withColumns({"channel": F.lit(self.channel), "connector": F.lit(self.name), "date_support": F.lit(self.date_support)})


REGISTRY: dict[str, Connector] = {}


def register(name: str, channel: str, date_support: str, **more) -> Callable:
    def add(parse):
        if name in REGISTRY:
            raise ValueError(f"two connectors are named {name}")
        REGISTRY[name] = Connector(name, channel, date_support, parse, **more)
        return parse

    return add


def registered() -> dict[str, Connector]:
    """All connectors, whatever was imported before."""
    from emberline.sources import gated, papers  # noqa: F401

    return REGISTRY


def select(exclude: set[str] = frozenset(), channel: str | None = None, only: set[str] | None = None, default_only: bool = True, historical: bool = False) -> list[Connector]:
    """Connectors by name, of all modules; historical runs leave out those that can't look back."""
    registered()
    out = [c for c in REGISTRY.values() if c.name not in exclude and (channel is None or c.channel == channel) and (only is None or c.name in only)]
    return [c for c in out if (c.default_on or not default_only or only is not None) and (c.historical or not historical)]


def refs(df: DataFrame, **columns: Column) -> DataFrame:
    unknown = set(columns) - set(COLUMNS)
    if unknown:
        raise ValueError(f"not in the reference schema: {unknown}")
    return df.select(*[columns.get(k, F.lit(None)).cast(t).alias(k) for k, t in COLUMNS.items()])


def items(bodies: DataFrame, schema: str, path: str) -> DataFrame:
    """One row for each element of an array inside the bodies; malformed bodies give none. Column x."""
    parsed = bodies.select(F.from_json("body", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select(F.explode(f"r.{path}").alias("x"))


def text_from_index(index: Column) -> Column:
    """An inverted index (word to positions) back to running text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def industry_share(types: Column) -> Column:
    """Share of companies among institution types; NULL for none."""
    return F.when(F.size(types) > 0, F.size(F.filter(types, lambda t: t == "company")) / F.size(types))


def localized(values: Column, languages: tuple[str, ...] = ("eng", "en")) -> Column:
    """The first of the preferred languages in a map, else any value."""
    return F.coalesce(*[F.try_element_at(values, F.lit(x)) for x in languages], F.element_at(F.map_values(values), 1))


x = F.col


class _Item:
    """Fields of the item column."""

    def __getitem__(self, name: str) -> Column:
        return F.col("x")[name]


V = _Item()


@register("openalex", "science", "strict")
def openalex(bodies: DataFrame) -> DataFrame:
    schema = "results array<struct<id:string,doi:string,title:string,publication_date:string,cited_by_count:int,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<institutions:array<struct<display_name:string,country_code:string,type:string>>>>>>"
    rows = items(bodies, schema, "results")
    return refs(rows, url=F.coalesce(V["doi"], V["id"]), title=V["title"], observed_at=dates.date_prefix(V["publication_date"]), text=text_from_index(V["abstract_inverted_index"]), source_id=F.lower(V["doi"]))


@register("nih", "money", "strict")
def nih(bodies: DataFrame) -> DataFrame:
    schema = "results array<struct<project_title:string,abstract_text:string,fiscal_year:int,award_amount:double,org_name:string,core_project_num:string,award_notice_date:string>>"
    rows = items(bodies, schema, "results")
    return refs(rows, url=F.concat(F.lit("https://reporter.nih.gov/project/"), V["core_project_num"]), title=V["project_title"], observed_at=dates.date_prefix(V["award_notice_date"]), text=V["abstract_text"], source_id=V["core_project_num"], kind=F.lit("grant"), amount=V["award_amount"], currency=F.lit("USD"), company=V["org_name"])


@register("cordis", "money", "strict")
def cordis(bodies: DataFrame) -> DataFrame:
    """The greatest amount of each project."""
    schema = "results struct<bindings:array<struct<project_id:struct<value:string>,title:struct<value:string>,abstract:struct<value:string>,start_date:struct<value:string>,funding_amount:struct<value:string>>>>"
    rows = items(bodies, schema, "results.bindings")
    best = rows.groupBy(V["project_id"]["value"].alias("id")).agg(F.max_by("x", F.coalesce(V["funding_amount"]["value"].try_cast("double"), F.lit(-1.0))).alias("x"))
    return refs(best, url=F.concat(F.lit("https://cordis.europa.eu/project/id/"), x("id")), title=V["title"]["value"], observed_at=dates.date_prefix(V["start_date"]["value"]), text=V["abstract"]["value"], source_id=x("id"), kind=F.lit("grant"), amount=V["funding_amount"]["value"].try_cast("double"), currency=F.lit("EUR"))


@register("github", "adoption", "post", historical=False)
def github(bodies: DataFrame) -> DataFrame:
    rows = items(bodies, "items array<struct<full_name:string,html_url:string,description:string,created_at:string,stargazers_count:int,fork:boolean,archived:boolean>>", "items")
    return refs(rows.where(~F.coalesce(V["fork"], F.lit(False)) & ~F.coalesce(V["archived"], F.lit(False))), url=V["html_url"], title=V["full_name"], observed_at=dates.date_prefix(V["created_at"]), text=V["description"], source_id=V["full_name"], amount=V["stargazers_count"])


def about(*columns: str):
    """Whether a reference's columns hold most word stems of one of the terms."""

    def fits(terms: list[str]) -> Column:
        own = stems(F.regexp_replace(F.concat_ws(" ", *columns), r"[-_/.]+", " "))
        wanted = F.array(*(key_stems(F.lit(t)) for t in terms)) if terms else F.array().cast("array<array<string>>")
        return F.exists(wanted, lambda t: relevant(own, t))

    return fits


def is_ml(terms: Column) -> Column:
    from emberline.sources.gated import is_ml_topic

    return is_ml_topic(terms)


@register("huggingface", "adoption", "post", historical=False, gate=is_ml, fits=about("source_id", "kind", "text"))
def huggingface(bodies: DataFrame) -> DataFrame:
    """Public models by task and tags; asked for topics of machine learning alone."""
    rows = bodies.select(F.explode(F.from_json("body", "array<struct<id:string,modelId:string,author:string,lastModified:string,likes:int,downloads:int,pipeline_tag:string,tags:array<string>,private:boolean>>")).alias("x"))
    name, task = F.trim(F.coalesce(F.nullif(V["modelId"], F.lit("")), V["id"])), F.coalesce(F.nullif(V["pipeline_tag"], F.lit("")), F.lit("unknown"))
    day, count = dates.date_prefix(V["lastModified"]), lambda n: F.coalesce(V[n], F.lit(0)).cast("string")
    text = F.concat(
        F.lit("Public Hugging Face model: "), name, F.lit(". Task: "), task, F.lit(". Downloads: "), count("downloads"), F.lit("; likes: "), count("likes"), F.lit("; last update: "),
        F.coalesce(day.cast("string"), F.lit("unknown")), F.lit(". Tags: "), F.array_join(F.slice(F.coalesce(V["tags"], F.array().cast("array<string>")), 1, 12), ", "), F.lit("."),
    )
    good = rows.where(~F.coalesce(V["private"], F.lit(False)) & (F.length(name) > 0))
    return refs(good, url=F.concat(F.lit("https://huggingface.co/"), name), title=F.concat(F.lit("Hugging Face model "), name), observed_at=day, text=text, source_id=name, kind=task, amount=V["downloads"])


@register("ted", "money", "strict")
def ted(bodies: DataFrame) -> DataFrame:
    """Tenders by localised title; a repeated title counts once, the first number standing for it."""
    rows = items(bodies, "notices array<struct<`publication-number`:string,`publication-date`:string,`notice-title`:map<string,string>,`buyer-name`:map<string,array<string>>>>", "notices")
    named = rows.select("x", localized(V["notice-title"]).alias("title"))
    first = named.groupBy("title").agg(F.min_by("x", V["publication-number"]).alias("x"))
    buyer = F.element_at(F.flatten(F.map_values(V["buyer-name"])), 1)
    return refs(first, url=F.concat(F.lit("https://ted.europa.eu/en/notice/-/detail/"), V["publication-number"]), title=x("title"), observed_at=dates.date_prefix(V["publication-date"]), source_id=V["publication-number"], kind=F.lit("tender"), customer=buyer)


@register("grants_gov", "money", "strict")
def grants_gov(bodies: DataFrame) -> DataFrame:
    rows = items(bodies, "data struct<oppHits:array<struct<id:string,number:string,title:string,agency:string,openDate:string>>>", "data.oppHits")
    return refs(rows, url=F.concat(F.lit("https://www.grants.gov/search-results-detail/"), V["id"]), title=V["title"], observed_at=F.try_to_date(V["openDate"], "MM/dd/yyyy"), source_id=V["number"], kind=F.lit("grant_call"), customer=V["agency"])


@register("nsf", "money", "strict")
def nsf(bodies: DataFrame) -> DataFrame:
    rows = items(bodies, "response struct<award:array<struct<id:string,title:string,date:string,startDate:string,fundsObligatedAmt:string,awardeeName:string,abstractText:string>>>", "response.award")
    return refs(rows, url=F.concat(F.lit("https://www.nsf.gov/awardsearch/showAward?AWD_ID="), V["id"]), title=V["title"], observed_at=F.try_to_date(F.coalesce(V["date"], V["startDate"]), "MM/dd/yyyy"), text=V["abstractText"], source_id=V["id"], kind=F.lit("grant"), amount=V["fundsObligatedAmt"].try_cast("double"), currency=F.lit("USD"), company=V["awardeeName"])


def ukri(projects: DataFrame, funds: DataFrame, organisations: DataFrame) -> DataFrame:
    """Projects (id, title, abstract, fund_id, org_id) with their fund (pounds, start in ms) and organisation (name)."""
    p = projects.select(F.from_json("body", "id string, title string, abstract string, fund_id string, org_id string").alias("x"))
    f = funds.select(F.from_json("body", "id string, start long, valuePounds struct<amount:double>").alias("f"))
    o = organisations.select(F.from_json("body", "id string, name string").alias("o"))
    rows = p.join(f, V["fund_id"] == x("f")["id"]).join(o, V["org_id"] == x("o")["id"], "left")
    return refs(rows, url=F.concat(F.lit("https://gtr.ukri.org/projects?ref="), V["id"]), title=V["title"], observed_at=dates.epoch_ms_day(x("f")["start"], "Europe/London"), text=V["abstract"], source_id=V["id"], kind=F.lit("grant"), amount=x("f")["valuePounds"]["amount"], currency=F.lit("GBP"), company=x("o")["name"])


@register("usaspending", "money", "strict")
def usaspending(bodies: DataFrame) -> DataFrame:
    """One row for each award, the first internal id standing for repeats."""
    rows = items(bodies, "results array<struct<`Award ID`:string,`Recipient Name`:string,`Award Amount`:double,`Start Date`:string,`Description`:string,`Awarding Agency`:string,generated_internal_id:string>>", "results")
    first = rows.groupBy(V["Award ID"].alias("award")).agg(F.min_by("x", V["generated_internal_id"]).alias("x"))
    return refs(first, url=F.concat(F.lit("https://www.usaspending.gov/award/"), V["generated_internal_id"]), title=V["Description"], observed_at=dates.date_prefix(V["Start Date"]), source_id=x("award"), kind=F.lit("contract"), amount=V["Award Amount"], currency=F.lit("USD"), company=V["Recipient Name"], customer=V["Awarding Agency"])


@register("sec_edgar", "money", "strict")
def sec_edgar(bodies: DataFrame) -> DataFrame:
    rows = items(bodies, "hits struct<hits:array<struct<_id:string,_source:struct<ciks:array<string>,display_names:array<string>,file_date:string,form:string,adsh:string>>>>", "hits.hits")
    s = V["_source"]
    cik = F.regexp_replace(F.element_at(s["ciks"], 1), "^0+", "")
    company = F.trim(F.regexp_replace(F.element_at(s["display_names"], 1), r"\s*\((?:CIK|[A-Z., -]+).*$", ""))
    file = F.substring_index(V["_id"], ":", -1)
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik, F.lit("/"), F.replace(s["adsh"], F.lit("-"), F.lit("")), F.lit("/"), file)
    return refs(rows, url=url, title=F.concat(company, F.lit(" "), s["form"]), observed_at=dates.date_prefix(s["file_date"]), source_id=V["_id"], kind=F.when(s["form"] == "D", "funding_round").otherwise("filing_mention"), company=company)


@register("venture_news", "money", "post")
def venture_news(bodies: DataFrame) -> DataFrame:
    rows = bodies.select(F.explode(F.from_json("body", "array<struct<date:string,link:string,title:struct<rendered:string>,excerpt:struct<rendered:string>>>")).alias("x"))
    title = strip_html(V["title"]["rendered"])
    amount, currency = money.amount_from_title(title)
    deal = amount.isNotNull() & F.lower(title).rlike(r"\b(raises|raised|secures|lands|closes|nabs)\b")
    company = F.nullif(F.regexp_extract(title, r"(?i)^(.+?)\s+(?:raises|raised|secures|lands|closes|nabs)\b", 1), F.lit(""))
    return refs(rows, url=V["link"], title=title, observed_at=dates.date_prefix(V["date"]), text=strip_html(V["excerpt"]["rendered"]), source_id=V["link"], kind=F.when(deal, "funding_round"), amount=F.when(deal, amount), currency=F.when(deal, currency), company=F.when(deal, company))


@register("yc", "money", "strict")
def yc(bodies: DataFrame) -> DataFrame:
    """Accelerator companies; a batch code (W21, S21, F24, X25) is the first day of its season."""
    rows = items(bodies, "companies array<struct<id:string,name:string,slug:string,oneLiner:string,longDescription:string,batch:string,status:string>>", "companies")
    season = F.element_at(F.create_map(*[F.lit(v) for kv in {"W": 1, "X": 4, "S": 6, "F": 9}.items() for v in kv]), F.substr(V["batch"], F.lit(1), F.lit(1)))
    day = F.make_date(F.regexp_extract(V["batch"], r"(\d{2})$", 1).try_cast("int") + 2000, season, F.lit(1))
    return refs(rows, url=F.concat(F.lit("https://www.ycombinator.com/companies/"), V["slug"]), title=V["name"], observed_at=day, text=F.concat_ws(" ", V["oneLiner"], V["longDescription"]), source_id=V["id"], kind=F.lit("accelerator"), company=V["name"])


@register("google_patents", "science", "strict")
def google_patents(bodies: DataFrame) -> DataFrame:
    """Priority, else filing date; a number counts once."""
    schema = "results struct<total_num_results:long,cluster:array<struct<result:array<struct<patent:struct<publication_number:string,title:string,snippet:string,priority_date:string,filing_date:string,publication_date:string,assignee:string>>>>>>"
    rows = items(bodies, schema, "results.cluster").select(F.explode("x.result").alias("y")).select(x("y")["patent"].alias("x"))
    first = rows.groupBy(V["publication_number"].alias("n")).agg(F.min_by("x", F.struct(V["priority_date"], V["title"])).alias("x"))
    day = dates.date_prefix(F.coalesce(F.nullif(V["priority_date"], F.lit("")), V["filing_date"]))
    return refs(first, url=F.concat(F.lit("https://patents.google.com/patent/"), x("n")), title=strip_html(V["title"]), observed_at=day, text=strip_html(V["snippet"]), source_id=x("n"), company=V["assignee"])


def patent_counts(totals: Column, shown: Column, relevant: Column) -> Column:
    """A window's total scaled by the relevant share of its first page."""
    return F.when(shown > 0, F.round(totals * relevant / shown).cast("long")).otherwise(F.lit(0))


def family_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


@register("rss", "market", "post")
def rss(bodies: DataFrame) -> DataFrame:
    """Feed items: title, link, pubDate, description, source."""
    part = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")), F.lit(""))
    rows = bodies.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("i"))
    title = strip_html(part("title"))
    return refs(rows, url=F.coalesce(part("link"), part("guid")), title=title, observed_at=dates.rss_date(part("pubDate")), text=strip_html(strip_html(part("description"))), source_id=F.coalesce(part("guid"), part("link")), company=part("source"))


def union_last(parts: list[DataFrame], key: str = "url") -> DataFrame:
    """References of several connectors; of a repeated key the last connector's stays."""
    from functools import reduce

    numbered = [p.withColumn("__k", F.lit(k)) for k, p in enumerate(parts)]
    both = reduce(DataFrame.unionByName, numbered)
    fields = [c for c in both.columns if c not in (key, "__k")]
    best = both.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct("__k", F.coalesce("observed_at", F.lit("0001-01-01").cast("date")), F.coalesce("title", F.lit("")))).alias("b"))
    return best.select(key, "b.*")


def first_nonempty(parts: list[DataFrame]) -> DataFrame:
    """The first source of a chain that has rows."""
    for p in parts[:-1]:
        if p.limit(1).count():
            return p
    return parts[-1]


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """Recorded bodies, one file each."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("body"))
