"""Maturity verdicts, kinds of negatives, tiers, and who may enter a training set.

All rules are columns over measured facts: NULL is unmeasured. Ages are days over 365.25 at the evaluation date.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.dedup import first_survivors, jaccard, word_pairs

# fixed values
MATURE_AGE_YEARS = 7
MATURE_VOLUME_3Y = 5000
FIRST_PUBLICATION_AGE = 10
LEAST_VOLUME = 15
FLAT_SLOPE = 0.08
RISING_SLOPE = 0.25
SILVER_NEWS = 3
GENERIC_TERM_WORDS = ("ai", "artificial", "intelligence", "robot", "robots", "system", "systems", "data", "model", "models")
LANGUAGES = ("en", "ru", "zh", "es", "fr", "de", "pt", "ja", "ko", "ar", "hi", "it", "tr", "id")


def _age(created: Column, as_of: date) -> Column:
    return F.datediff(F.lit(as_of), created) / F.lit(365.25)


def maturity_verdict(article: Column, asked: Column, volumes: list[tuple[Column, Column]], preprints: tuple[Column, Column], as_of: date) -> Column:
    """mature, unverified or early.

    article is the encyclopedia article's first day and asked whether that source answered; volumes are (count,
    answered) of the volume sources in order of preference; preprints counts towards `found at all` alone.
    """
    known = [F.when(ok, n) for n, ok in volumes]
    every = F.array_compact(F.array(*known, F.when(preprints[1], preprints[0])))
    answered = F.coalesce(asked, F.lit(False)) | preprints[1]
    for _, ok in volumes:
        answered = answered | ok
    return (
        F.when(asked & (_age(article, as_of) >= MATURE_AGE_YEARS), "mature")
        .when(F.coalesce(*known) >= MATURE_VOLUME_3Y, "mature")
        .when(~answered, "unverified")
        .when(F.array_max(every) == 0, "unverified")
        .otherwise("early")
    )


def pool_limits(facts: DataFrame, volume: str) -> DataFrame:
    """high_volume, top_quartile: the values at indexes floor(0.9 n) and floor(0.75 n) of the sorted volumes, from counts by value."""
    by = facts.groupBy(F.col(volume).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    run = by.select("v", F.sum("c").over(Window.orderBy("v")).alias("upto"), F.sum("c").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("of"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * F.col("of")), F.col("v")))
    return run.agg(at(0.9).alias("high_volume"), at(0.75).alias("top_quartile"))


def negative_kind(verdict: Column, article: Column, recent: Column, first_year: Column, slope: Column, high_volume: Column, top_quartile: Column, as_of: date) -> Column:
    """N1 (established), N3e (flat), N3d (rising but already broad), or NULL where nothing can be concluded."""
    return (
        F.when(verdict == "unverified", None)
        .when(verdict == "mature", "N1")
        .when(_age(article, as_of) >= MATURE_AGE_YEARS, "N1")
        .when(recent < LEAST_VOLUME, None)
        .when((F.lit(as_of.year) - first_year >= FIRST_PUBLICATION_AGE) & (recent >= high_volume), "N1")
        .when(slope <= FLAT_SLOPE, "N3e")
        .when((recent >= top_quartile) & (slope >= RISING_SLOPE), "N3d")
    )


def tier(label: Column, news: Column, money: list[Column]) -> Column:
    """silver, bronze or drop: how much a row may be trusted."""
    n = F.coalesce(news, F.lit(0))
    paid = F.greatest(F.lit(0.0), *[F.coalesce(m.cast("double"), F.lit(0.0)) for m in money]) > 0
    positive = F.coalesce(label == 1, F.lit(False))
    return F.when(~positive | (n >= SILVER_NEWS), "silver").when((n > 0) | paid, "bronze").otherwise("drop")


def training_languages(key: Column, width: int = 6) -> Column:
    """English and Russian, then others in turn from a place given by the key's hash."""
    width = max(2, min(width, len(LANGUAGES)))
    others = [x for x in LANGUAGES if x not in ("en", "ru")]
    listed = F.array(*[F.lit(x) for x in others])
    start = F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(8)), 16, 10).cast("long") % len(others)
    turn = [F.element_at(listed, ((start + i) % len(others) + 1).cast("int")) for i in range(width - 2)]
    return F.array(F.lit("en"), F.lit("ru"), *turn)


def term_words(term: Column) -> Column:
    """Distinct Latin words and digits of a term, without the generic ones."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(term, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*GENERIC_TERM_WORDS)))


def excluded_terms(terms: DataFrame, excluded: DataFrame) -> DataFrame:
    """Terms (column term) that an excluded term (column term) covers: one within the other, or Jaccard at least 0.6.

    Only terms of two words or more count, on both sides. Any match shares a word, so an equi-join on words finds
    them all; shared words are counted before the rule is asked, and NULL terms never match.
    """
    own = terms.select("term", term_words(F.col("term")).alias("w")).where(F.size("w") >= 2).distinct()
    other = excluded.select(term_words(F.col("term")).alias("o")).where(F.size("o") >= 2).select(F.array_sort("o").alias("o")).distinct()
    a = own.select("term", F.size("w").alias("n"), F.explode("w").alias("word"))
    b = other.select("o", F.size("o").alias("m"), F.explode("o").alias("word"))
    met = a.join(b, "word").groupBy("term", "n", "o", "m").agg(F.count(F.lit(1)).alias("k"))
    covers = (F.col("k") == F.col("n")) | (F.col("k") == F.col("m")) | (F.col("k") / (F.col("n") + F.col("m") - F.col("k")) >= 0.6)
    return met.where(covers).select("term").distinct()


def claim_names(names: DataFrame) -> DataFrame:
    """id, claimed of names (id long, name) in the order of id.

    A name is refused where an earlier claimed one shares over 0.6 of their words of four letters and more, or where
    it has no such word. NULL names have none.
    """
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-zа-я0-9]+", " "))
    words = names.select("id", F.array_distinct(F.filter(F.split(clean, " "), lambda w: F.length(w) > 3)).alias("w"))
    some = words.where(F.size("w") > 0)
    settled = first_survivors(some.select("id"), word_pairs(some, "w", jaccard(F.col("a"), F.col("b")) > 0.6, 0.6, neighbours=False))
    return words.select("id").join(settled.select("id", F.col("duplicate_of").isNull().alias("free")), "id", "left").select("id", F.coalesce("free", F.lit(False)).alias("claimed"))


def eligible_products(repos: DataFrame, used_urls: DataFrame, used_names: DataFrame, names: tuple[str, ...], wanted: str, unwanted: str, as_of: date) -> DataFrame:
    """Products among repositories (name, description, html_url, homepage, fork, archived, created_at).

    It has a name, url, description and homepage, is neither fork nor archived, was there at the evaluation date, says
    what is wanted and nothing unwanted (patterns), and neither its url nor its name is in use.
    """
    filled = lambda x: F.coalesce(F.length(x) > 0, F.lit(False))
    own = repos.where(filled("name") & filled("html_url") & filled("description") & filled("homepage"))
    own = own.where(~F.coalesce("fork", F.lit(False)) & ~F.coalesce("archived", F.lit(False)) & (F.substr("created_at", F.lit(1), F.lit(10)) <= as_of.isoformat()))
    own = own.where(~F.lower("name").isin(*names) & ~F.concat_ws(" ", "name", "description").rlike(unwanted) & F.col("description").rlike(wanted))
    urls, taken = used_urls.select(F.lower("html_url").alias("__u")).distinct(), used_names.select(F.lower("name").alias("__n")).distinct()
    return own.join(urls, F.lower("html_url") == F.col("__u"), "left_anti").join(taken, F.lower("name") == F.col("__n"), "left_anti")
