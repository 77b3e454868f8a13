"""Summaries for cards and reports: publications, institutions, money events, agreement, supplements, cycles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.windows import keep_first, top_n


def publication_summary(years: DataFrame, key: str) -> DataFrame:
    """key, total, recent_3y, recent_share, by_year (latest six years, year to count) from rows of (key, year, n).

    recent_3y counts the three latest years; unknown years count to the total alone.
    """
    by = years.groupBy(key, "year").agg(F.sum("n").alias("n"))
    latest = by.withColumn("latest", F.max("year").over(Window.partitionBy(key)))
    of = lambda last: F.sum(F.when(F.col("year") > F.col("latest") - last, F.col("n")))
    kept = F.array_sort(F.collect_list(F.when(F.col("year") >= F.col("latest") - 5, F.struct("year", "n"))))
    found = latest.groupBy(key).agg(F.sum("n").alias("total"), F.coalesce(of(3), F.lit(0)).alias("recent_3y"), F.map_from_entries(kept).alias("by_year"))
    return found.select(key, "total", "recent_3y", F.when(F.col("total") > 0, F.round(F.col("recent_3y") / F.col("total"), 4)).alias("recent_share"), "by_year")


def institution_stats(works: DataFrame, key: str) -> DataFrame:
    """key, institutions, countries, industry_share, hhi of works (key, work, institution, country, type), one row for each affiliation.

    An institution counts once a work in the concentration; works without institutions count in the share alone.
    Counts are by institution first, so a key with many works is spread.
    """
    once = works.where("institution is not null").select(key, "work", "institution").distinct()
    by = once.groupBy(key, "institution").agg(F.count(F.lit(1)).alias("n"))
    spread = by.groupBy(key).agg(F.count(F.lit(1)).alias("institutions"), (F.sum(F.pow(F.col("n").cast("double"), F.lit(2.0))) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("hhi"))
    lands = works.where("country is not null").select(key, "country").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("countries"))
    each = works.groupBy(key, "work").agg(F.max(F.coalesce(F.col("type") == "company", F.lit(False)).cast("int")).alias("company"))
    share = each.groupBy(key).agg(F.avg("company").alias("industry_share"))
    out = share.join(spread, key, "left").join(lands, key, "left")
    return out.select(key, F.coalesce("institutions", F.lit(0)).alias("institutions"), F.coalesce("countries", F.lit(0)).alias("countries"), "industry_share", "hhi")


def money_events(references: DataFrame, key: str, order: list[Column], as_of: date, reviewed: int = 40, relevant: Column | None = None, most: int = 12) -> DataFrame:
    """The latest money events of each key: dated, not after as_of, one for each first six words of the title (else url).

    The first of repeats in `order` stays. Where relevant is given, it is asked of the latest `reviewed` alone.
    """
    own = references.where((F.col("channel") == "money") & (F.col("day") <= F.lit(as_of)))
    words = F.regexp_extract_all(F.lower(F.coalesce(F.nullif("title", F.lit("")), "url")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    once = keep_first(own.withColumn("__head", F.array_join(F.slice(words, 1, 6), " ")), [key, "__head"], order).drop("__head")
    latest = [F.col("day").desc(), *order]
    if relevant is not None:
        once = top_n(once, [key], latest, reviewed).where(relevant)
    return top_n(once, [key], latest, most)


def agreement(pairs: DataFrame, threshold: float) -> DataFrame:
    """One row: decision, stage, mean_abs_difference, median_seconds, p90_seconds of rows (p_a, p_b, stage_a, stage_b, seconds).

    p90 is the value at index floor(0.9 (n - 1)); both quantiles come from counts by value.
    """
    a, b = F.col("p_a"), F.col("p_b")
    mean = lambda x: F.round(F.avg(x.cast("double")), 3)
    one = pairs.agg(mean((a >= threshold) == (b >= threshold)).alias("decision"), mean(F.col("stage_a").eqNullSafe(F.col("stage_b"))).alias("stage"), mean(F.abs(a - b)).alias("mean_abs_difference"))
    by = pairs.where("seconds is not null").groupBy("seconds").agg(F.count(F.lit(1)).alias("c"))
    run = by.select("seconds", F.sum("c").over(Window.orderBy("seconds")).alias("upto"), F.sum("c").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("of"))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("seconds")))
    n = F.col("of")
    took = run.agg(F.round((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, 1).alias("median_seconds"), F.round(at(F.floor(F.lit(0.9) * (n - 1))), 1).alias("p90_seconds"))
    return one.crossJoin(F.broadcast(took))


def supplemented(records: DataFrame, more: DataFrame, key: str, fields: list[str], as_of: date) -> DataFrame:
    """Records with fields filled, where NULL, from the latest of `more` (key, day, fields) that isn't after as_of."""
    known = more.where(F.col("day") <= F.lit(as_of)).groupBy(key).agg(F.max_by(F.struct(*fields), F.struct("day", *fields)).alias("__m"))
    rest = [c for c in records.columns if c not in fields]
    return records.join(known, key, "left").select(*rest, *[F.coalesce(F.col(f), F.col("__m")[f]).alias(f) for f in fields])


def cycle_position(bucket: Column, place: Column, cycle: list[str]) -> Column:
    """Where a bucket's item goes when buckets take turns by `cycle`: struct(round, slot), to order by.

    place is the item's place in its bucket, from 0. A bucket that comes up twice in the cycle gives two items a round;
    those of buckets that the cycle doesn't name come last, in one round.
    """
    out = F.struct(F.lit(2**31 - 1).cast("long").alias("round"), place.cast("long").alias("slot"))
    for name in dict.fromkeys(cycle):
        slots = [k for k, b in enumerate(cycle) if b == name]
        slot = F.element_at(F.array(*[F.lit(k).cast("long") for k in slots]), (place % len(slots) + 1).cast("int"))
        out = F.when(bucket == name, F.struct(F.floor(place / len(slots)).cast("long").alias("round"), slot.alias("slot"))).otherwise(out)
    return out


def judge_scores(rows: DataFrame) -> DataFrame:
    """model, judged, event_precision, event_recall, mean_overall, win_share of judged extractions (id, model, events, ok, missed, overall).

    The best overall mark of an id is a win, shared among models that have it; the share is of all ids.
    """
    best = rows.groupBy("id").agg(F.max("overall").alias("__best"))
    ties = rows.join(best, "id").where(F.col("overall") == F.col("__best")).groupBy("id").agg(F.first("__best").alias("__best"), F.count(F.lit(1)).alias("__ties"))
    marked = rows.join(ties, "id", "left").withColumn("__win", F.when(F.col("overall") == F.col("__best"), 1 / F.col("__ties")).otherwise(0.0))
    by = marked.groupBy("model").agg(
        F.count(F.lit(1)).alias("judged"), F.sum("events").alias("e"), F.sum("ok").alias("o"), F.sum("missed").alias("m"), F.avg("overall").alias("a"), F.sum("__win").alias("w")
    )
    total = rows.agg(F.count_distinct("id").alias("n"))
    return by.crossJoin(F.broadcast(total)).select(
        "model", "judged", F.round(F.col("o") / F.greatest("e", F.lit(1)), 3).alias("event_precision"), F.round(F.col("o") / F.greatest(F.col("o") + F.col("m"), F.lit(1)), 3).alias("event_recall"),
        F.round("a", 2).alias("mean_overall"), F.round(F.col("w") / F.col("n"), 3).alias("win_share"),
    )
