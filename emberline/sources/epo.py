"""A patent office's bibliographic answers: fields that are one object or an array of objects, read as VARIANT.

The service writes a single title, claim, applicant or document as an object and several as an array, so no fixed schema
fits. Bodies are parsed once to VARIANT; as_array() makes one shape of both, and paths are read from there.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import dates
from emberline.functions.text import key_stems, relevant, stems, strip_html

DATED = ("docdb", "epodoc")  # of a document's ids those whose date counts


def at(node: Column, *names: str) -> Column:
    """The node under these names; NULL where there is none."""
    return F.try_variant_get(node, "$" + "".join(f"['{n}']" for n in names), "variant")


def as_array(node: Column) -> Column:
    """An array of nodes from an array, an object or a scalar; empty for null and nothing."""
    some = node.isNotNull() & ~F.is_variant_null(node)
    return F.when(some, F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.array(node))).otherwise(F.array().cast("array<variant>"))


def content(node: Column) -> Column:
    """An object's text under $ (none: empty), a scalar as it is, empty for nothing."""
    whole = F.when(F.try_variant_get(node, "$", "map<string,variant>").isNull(), F.try_variant_get(node, "$", "string"))
    return F.coalesce(F.try_variant_get(node, "$['$']", "string"), whole, F.lit(""))


def document_date(documents: Column) -> Column:
    """The date of the first document of a known kind that has one."""
    good = F.filter(documents, lambda d: F.try_variant_get(d, "$['@document-id-type']", "string").isin(*DATED) & (content(at(d, "date")) != ""))
    return dates.compact_date(content(at(F.get(good, F.lit(0)), "date")))


def cleaned(text: Column) -> Column:
    return strip_html(F.replace(F.coalesce(text, F.lit("")), F.lit("…"), F.lit(" ")))


def found_numbers(bodies: DataFrame, *keep: str) -> DataFrame:
    """The columns named, total, numbers (country.number.kind, complete ones) of search answers; malformed ones give nothing."""
    search = at(F.try_parse_json("body"), "ops:world-patent-data", "ops:biblio-search")
    refs = as_array(at(F.col("s"), "ops:search-result", "ops:publication-reference"))
    numbers = F.transform(refs, lambda r: F.array(*(content(at(r, "document-id", n)) for n in ("country", "doc-number", "kind"))))
    whole = F.filter(numbers, lambda n: ~F.array_contains(n, ""))
    rows = bodies.select(*keep, search.alias("s")).where("s IS NOT NULL")
    return rows.select(*keep, F.coalesce(F.try_variant_get("s", "$['@total-result-count']", "long"), F.lit(0)).alias("total"), F.transform(whole, lambda n: F.array_join(n, ".")).alias("numbers"))


def records(bodies: DataFrame) -> DataFrame:
    """number, title, abstract, assignee, publication, priority of each document of biblio answers.

    The English title, else the first; English paragraphs of abstracts (no language counts as English) joined; the priority is
    the earliest-listed claim's date, else the application's.
    """
    docs = as_array(at(F.try_parse_json("body"), "ops:world-patent-data", "exchange-documents", "exchange-document"))
    rows = bodies.select(F.explode(docs).alias("d")).withColumn("b", at(F.col("d"), "bibliographic-data"))
    d, b = F.col("d"), F.col("b")
    lang = lambda n: F.try_variant_get(n, "$['@lang']", "string")
    titles = as_array(at(b, "invention-title"))
    english = content(F.get(F.filter(titles, lambda t: lang(t) == "en"), F.lit(0)))
    abstracts = F.filter(as_array(at(d, "abstract")), lambda a: F.coalesce(lang(a), F.lit("en")) == "en")
    paragraphs = F.flatten(F.transform(abstracts, lambda a: as_array(at(a, "p"))))
    ids = lambda *names: as_array(at(b, *names, "document-id"))
    claims = F.flatten(F.transform(as_array(at(b, "priority-claims", "priority-claim")), lambda c: as_array(at(c, "document-id"))))
    applicants = as_array(at(b, "parties", "applicants", "applicant"))
    mark = lambda name: F.coalesce(F.try_variant_get(d, f"$['@{name}']", "string"), F.lit(""))
    return rows.select(
        F.concat(mark("country"), mark("doc-number"), mark("kind")).alias("number"),
        cleaned(F.coalesce(F.nullif(english, F.lit("")), content(F.get(titles, F.lit(0))))).alias("title"),
        cleaned(F.array_join(F.transform(paragraphs, content), " ")).alias("abstract"),
        cleaned(content(at(F.get(applicants, F.lit(0)), "applicant-name", "name"))).alias("assignee"),
        document_date(ids("publication-reference")).alias("publication"),
        F.coalesce(document_date(claims), document_date(ids("application-reference"))).alias("priority"),
    )


def references(found: DataFrame, as_of: date, phrases: list[str] | None = None) -> DataFrame:
    """Records known on the day as references: url, title, text, observed_at (priority, else publication), source_id, company, publication, priority.

    Without number, title or date, or dated or published later, they go; with phrases only records relevant to one of them stay.
    """
    day, published = F.coalesce("priority", "publication"), F.col("publication")
    good = found.where((F.col("number") != "") & (F.col("title") != "") & (day <= F.lit(as_of)) & (published.isNull() | (published <= F.lit(as_of))))
    if phrases is not None:
        text = F.concat_ws(" ", "title", "abstract")
        good = good.where(F.exists(F.array(*(key_stems(F.lit(p)) for p in phrases)), lambda p: relevant(stems(text), p)) if phrases else F.lit(False))
    maker = F.when(F.col("assignee") != "", F.concat(F.lit("Assignee: "), "assignee"))
    return good.select(
        F.concat(F.lit("https://patents.google.com/patent/"), "number", F.lit("/en")).alias("url"), "title",
        F.concat_ws(". ", "title", F.nullif(F.col("abstract"), F.lit("")), maker).alias("text"), day.alias("observed_at"), F.col("number").alias("source_id"),
        F.nullif(F.col("assignee"), F.lit("")).alias("company"), "publication", "priority",
    )
