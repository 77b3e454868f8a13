"""Pools of labelled candidates over several runs: labels as of a past date, and merges that keep what annotators did."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OLD_YEARS = 7  # fixed value: what is known for longer than that was mature
MATURE = 5


def plausible_year(year: Column, today: date) -> Column:
    """A year from 1900 to this one; NULL for anything else."""
    whole = year.try_cast("int")
    return F.when(whole.between(1900, today.year), whole)


def retro_labels(candidates: DataFrame, as_of: date, today: date) -> DataFrame:
    """id, label, negative_type, decision, reason of each candidate as of a past date: a veto of three sources.

    candidates: id, title, n_articles (seen on the day), stage and stage_quote (what the articles say), wiki_stage, wiki_age
    (years) and wiki_revision (of the article as it stood then; NULL without one), established (a year, as text). Mature by any
    of the three is a negative, and the first of them is the reason: the articles' stage, the encyclopaedia's stage, its
    article's age, the year it was known from. Without articles there is nothing to label and the candidate is dropped.
    """
    since = plausible_year(F.col("established"), today)
    by_age, by_year = F.col("wiki_age") > OLD_YEARS, F.lit(as_of.year) - since > OLD_YEARS
    why = (
        F.when(F.col("stage") == MATURE, "articles")
        .when(F.col("wiki_stage") == MATURE, F.concat(F.lit("encyclopaedia of "), F.substr(F.coalesce("wiki_revision", F.lit("")), F.lit(1), F.lit(10))))
        .when(by_age, F.concat(F.lit("its article is "), F.format_number("wiki_age", 0), F.lit(" years old")))
        .when(by_year, F.concat(F.lit("known since "), since.cast("string")))
    )
    drop = F.coalesce("n_articles", F.lit(0)) == 0
    signal = F.concat(F.lit("stage "), F.coalesce(F.col("stage").cast("string"), F.lit("unknown")), F.lit(": "), F.substr(F.coalesce("stage_quote", F.lit("")), F.lit(1), F.lit(120)))
    rows = candidates.select("id", "title", drop.alias("drop"), why.alias("why"), signal.alias("signal"))
    return rows.select(
        "id",
        F.when(~F.col("drop"), F.when(F.col("why").isNull(), "1").otherwise("0")).alias("label"),
        F.when(~F.col("drop"), F.when(F.col("why").isNull(), "").otherwise("N1_mature_at_T")).alias("negative_type"),
        F.when(F.col("drop"), "drop").otherwise("keep").alias("decision"),
        F.when(F.col("drop"), "no documents on the day").when(F.col("why").isNull(), F.col("signal")).otherwise(F.concat(F.lit("mature then ("), "why", F.lit(")"))).alias("reason"),
    )


def parent_negatives(positives: DataFrame, parents: DataFrame) -> DataFrame:
    """id, title, label, negative_type, reason: the mature technology that each positive grew out of (id, parent_id, parent_title, wiki_stage).

    A parent of several positives stands once, for the smallest id; one that isn't mature is none.
    """
    mature = parents.where(F.col("wiki_stage") == MATURE).join(positives.select("id", F.col("title").alias("positive")), "id")
    first = mature.groupBy("parent_id").agg(F.min(F.struct("id", "parent_title", "positive")).alias("p"))
    reason = F.concat(F.lit("mature counterpart of "), F.substr(F.col("p.positive"), F.lit(1), F.lit(60)))
    return first.select(F.col("parent_id").alias("id"), F.col("p.parent_title").alias("title"), F.lit("0").alias("label"), F.lit("N1_parent_at_T").alias("negative_type"), reason.alias("reason"))


def merge_pool(pool: DataFrame, rows: DataFrame, touched: list[str]) -> DataFrame:
    """The pool after a run over some domains: their rows are the run's, with assignment and status of rows handed out before; other domains' rows stay.

    Both: id, domain, assigned_to, status and further columns. Rows of the pool without an id go. A run's row that was in a
    touched domain before takes over what was there: no assignment is the empty text, no status is new. Where the pool holds an
    id more than once, its assigned row counts, of several the smallest. A repeated run over the same rows changes nothing.
    """
    known = pool.where(F.coalesce(F.col("id").cast("string"), F.lit("")) != "")
    inside = F.coalesce(F.col("domain").isin(touched), F.lit(False)) if touched else F.lit(False)
    held = F.struct((F.coalesce("assigned_to", F.lit("")) == "").alias("none"), F.coalesce("assigned_to", F.lit("")).alias("assigned_to"), F.coalesce("status", F.lit("new")).alias("status"))
    before = known.where(inside).groupBy(F.col("id").alias("id_before")).agg(F.min(held).alias("held_before"))
    joined = rows.join(before, rows["id"] == before["id_before"], "left")
    found = F.col("held_before").isNotNull()
    own = joined.select(*(F.when(found, F.col(f"held_before.{c}")).otherwise(rows[c]).alias(c) if c in ("assigned_to", "status") else rows[c] for c in rows.columns))
    return known.where(~inside).unionByName(own, allowMissingColumns=True)
