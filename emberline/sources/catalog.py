"""Catalogues from headless grids: the header is found, columns are read by name; printed page numbers from page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import strings

# The columns of a catalogue sheet by the names they bear there; a header has at least the two marked first.
NAMES = {
    "title": "Технология (слабый сигнал)", "sources": "Источники", "id": "№", "domain": "Область", "companies": "Компании", "reference_explanation": "Почему это слабый сигнал",
    "stage": "Стадия развития", "mention_trend": "Тренд упоминаний", "reference_score": "Балл (стадия+тренд)",
}
RECORD = r"""(?:[^"\r\n]++|"(?:[^"]++|"")*+"?)++"""
FIELD = r"""(?:^|,)("(?:[^"]++|"")*+"?|[^,]*+)"""
LINK = r"\[([^\]]+)\]\((https?://[^\s)]+)\)"


def grid(bodies: DataFrame) -> DataFrame:
    """sheet, row (from 1), cells of CSV texts (sheet, body); quoted cells may hold commas, quotes and line ends."""
    text = F.regexp_replace(F.coalesce("body", F.lit("")), "^﻿", "")
    # every line end outside quotes ends a row, empty rows too, so that row numbers are those of the file
    lines = F.regexp_extract_all(text, F.lit(rf"({RECORD})?(\r\n|\n|\r|$)"), F.lit(0))
    rows = bodies.select("sheet", F.posexplode(lines).alias("n", "line")).withColumn("line", F.regexp_replace("line", r"[\r\n]+$", ""))
    cell = lambda c: F.trim(F.replace(F.regexp_replace(c, r'(?s)^"(.*?)"?$', "$1"), F.lit('""'), F.lit('"')))
    return rows.select("sheet", (F.col("n") + 1).alias("row"), F.transform(F.regexp_extract_all("line", F.lit(FIELD), F.lit(1)), cell).alias("cells"))


def catalogue(cells: DataFrame, names: dict[str, str] = NAMES) -> DataFrame:
    """One record for each row with a number under a header: id, the named columns, links (title, url) of sources, sheet, row.

    A header is a row with the names of title and sources among its cells; it holds until the next header of its sheet. Rows
    before the first and rows without a number are no records; a name the header lacks gives NULL. Headers are few and
    are joined as one list a sheet, so rows of a long sheet stay where they are.
    """
    is_header = F.array_contains("cells", names["title"]) & F.array_contains("cells", names["sources"])
    headers = cells.where(is_header).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("row", F.col("cells").alias("header")))).alias("headers"))
    rows = cells.where(~is_header).join(F.broadcast(headers), "sheet")
    above = F.filter("headers", lambda h: h["row"] < F.col("row"))
    named = rows.where(F.size(above) > 0).withColumn("header", F.element_at(above, -1)["header"])
    # of a name that stands twice the last column counts
    place = lambda name: F.when(F.array_contains("header", name), F.size("header") + 1 - F.array_position(F.reverse("header"), name))
    value = {k: F.get("cells", (place(v) - 1).cast("int")) for k, v in names.items()}
    number = value["id"].try_cast("double")
    pairs = F.transform(F.arrays_zip(F.regexp_extract_all(value["sources"], F.lit(LINK), F.lit(1)).alias("t"), F.regexp_extract_all(value["sources"], F.lit(LINK), F.lit(2)).alias("u")), lambda p: F.struct(p["t"].alias("title"), p["u"].alias("url")))
    rest = [F.nullif(v, F.lit("")).alias(k) for k, v in value.items() if k not in ("id", "sources")]
    return named.where(number.isNotNull()).select(number.cast("long").alias("id"), *rest, F.coalesce(pairs, F.array().cast("array<struct<title:string,url:string>>")).alias("links"), "sheet", "row")


def or_fallback(records: DataFrame, fallback: DataFrame) -> DataFrame:
    """The records, or those of the fallback where there are none; one plan, nothing is asked beforehand."""
    some = records.select(F.lit(1).alias("__some")).limit(1)
    spare = fallback.withColumn("__one", F.lit(1)).join(F.broadcast(some), F.col("__one") == F.col("__some"), "left_anti").drop("__one")
    return records.unionByName(spare, allowMissingColumns=True)


LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def printed_number(text: Column, around: int = 3) -> Column:
    """The first of a page's first and last lines that is a number of up to three digits alone."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    ends = F.concat(F.slice(lines, 1, around), F.slice(lines, -F.least(F.lit(around), F.size(lines)), around))
    found = F.filter(F.when(F.size(lines) > 0, ends).otherwise(strings()), lambda x: x.rlike(r"^\s*\d{1,3}\s*$"))
    return F.trim(F.regexp_replace(F.get(found, F.lit(0)), r"\s", "")).cast("int")


def printed_numbers(pages: DataFrame) -> DataFrame:
    """doc_id, page, printed: printed page numbers of pages (doc_id, page from 0, text).

    Pages without a number of their own are counted on by the offset that most numbered pages of the document have (the
    smallest of equally frequent ones, 0 without any). Offsets are counted by (document, offset) before they meet by document.
    """
    own = pages.select("doc_id", "page", printed_number(F.col("text")).alias("own"))
    offsets = own.where("own IS NOT NULL").groupBy("doc_id", (F.col("page") + 1 - F.col("own")).alias("offset")).agg(F.count(F.lit(1)).alias("n"))
    modal = offsets.groupBy("doc_id").agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("offset"))
    return own.join(modal, "doc_id", "left").select("doc_id", "page", F.coalesce("own", F.col("page") + 1 - F.coalesce("offset", F.lit(0))).cast("int").alias("printed"))
