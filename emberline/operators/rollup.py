"""Works and sources of a technology rolled up over request windows and calendar years.

science_rollup and science_years read the works that dated requests returned, several providers a window, and say what is
known: a request that failed leaves its days unknown, and a year is known only where successful requests cover each of its days.
fill_channel_years puts dated sources of a candidate into the channel-years that no query has measured.

All keys are aggregated by (technology, window, work) or (candidate, channel, year) before anything meets by technology alone,
so a technology with a third of all works is spread by its works.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.dates import years_before

DAY = timedelta(days=1)
CAP = 1000  # a request returns no more works than that: a count that reaches it is a lower bound
OLDER = 3
PROVIDERS = ("crossref", "openalex")  # of one work in both the first one's record stays


def windows(snapshot: date) -> list[tuple[date, date]]:
    """First and last day of the request windows: two years each, and all before."""
    b2, b4, b6 = (years_before(snapshot, y) for y in (2, 4, 6))
    return [(b2, snapshot), (b4, b2 - DAY), (b6, b4 - DAY), (date(1900, 1, 1), b6 - DAY)]


def work_key(doi: Column, title: Column) -> Column:
    """doi:... without the resolver and in lower case, else title:... without signs."""
    bare = F.trim(F.lower(F.regexp_replace(F.coalesce(doi, F.lit("")), "^https?://doi.org/", "")))
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))
    return F.when(bare != "", F.concat(F.lit("doi:"), bare)).otherwise(F.concat(F.lit("title:"), plain))


def _first_works(works: DataFrame, snapshot: date) -> DataFrame:
    """tech_id, window, key, n (records), rec (the first record), day (the first that is a date up to the snapshot).

    In the three recent windows a record without a title is nobody's, and only the first record of a key counts, its date with it.
    """
    day = F.try_to_date(F.substr(F.coalesce("published", F.lit("")), F.lit(1), F.lit(10)), "yyyy-MM-dd")
    titled = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"[^\p{L}\p{N}_]+", " ")) != ""
    order = F.struct(F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("provider")).alias("p"), F.col("position"))
    rows = works.where((F.col("window") == OLDER) | titled).withColumns({"key": work_key(F.col("doi"), F.col("title")), "__day": F.when(day <= F.lit(snapshot), day), "__at": order})
    rec = F.struct("title", "published", "institutions", "countries", "industry_share", F.col("__day").alias("day"))
    out = rows.groupBy("tech_id", "window", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(rec, "__at").alias("rec"), F.min_by(F.col("__day"), F.when(F.col("__day").isNotNull(), F.col("__at"))).alias("early"), F.min(F.nullif(F.col("published"), F.lit(""))).alias("least")
    )
    return out.withColumn("day", F.when(F.col("window") == OLDER, F.col("early")).otherwise(F.col("rec.day"))).drop("early")


def _answered(answers: DataFrame) -> DataFrame:
    """tech_id, window: requests of which some provider succeeded. Of the time before the windows the first provider alone is asked."""
    asked = (F.col("window") < OLDER) | (F.col("provider") == PROVIDERS[0])
    return answers.where(F.col("ok") & asked).select("tech_id", "window").distinct()


def science_rollup(works: DataFrame, answers: DataFrame, snapshot: date) -> DataFrame:
    """One row for each tech_id of answers.

    works: tech_id, provider, window (0 to 2: the last two, two to four, four to six years; 3: before), position (in the
    response), doi, title, published (text), institutions, countries (arrays), industry_share. answers: tech_id, provider,
    window, ok. Counts of a technology without a successful request are zero and ok is false: nothing was measured.
    """
    b3 = years_before(snapshot, 3).isoformat()
    found = _first_works(works, snapshot)
    w = F.col("window")
    recent = (w == 0) | ((w == 1) & (F.col("rec.published") >= b3))
    dated3 = recent & (F.col("rec.published") >= b3)
    least = lambda k: F.min(F.when(w == k, F.col("least") if k == OLDER else F.nullif(F.col("rec.published"), F.lit(""))))
    share = F.col("rec.industry_share")
    counts = found.groupBy("tech_id").agg(
        *(F.count_if(w == k).alias(f"window_{k}") for k in range(OLDER)),
        F.sum(F.when(w == OLDER, F.col("n")).otherwise(0)).alias("n_older"),
        F.count_if(F.coalesce(recent, F.lit(False))).alias("count_3y"),
        F.round(F.avg(F.when(dated3, share)), 6).alias("industry_affiliation_share_3y"),
        *(least(k).alias(f"least_{k}") for k in range(OLDER + 1)),
    )
    distinct = found.where("key <> 'title:'").groupBy("tech_id", "key").agg(F.lit(1).alias("one")).groupBy("tech_id").agg(F.count(F.lit(1)).alias("total"))
    named = found.where(dated3)

    def labels(column: str, name: str) -> DataFrame:
        each = named.select("tech_id", F.explode(f"rec.{column}").alias("label")).where("label is not null")
        return each.groupBy("tech_id", "label").agg(F.lit(1).alias("one")).groupBy("tech_id").agg(F.count(F.lit(1)).alias(name))

    got = _answered(answers).groupBy("tech_id").agg(F.count_if(w == OLDER).alias("older_ok"), *(F.count_if(w == k).alias(f"ok_{k}") for k in range(OLDER)))
    out = answers.select("tech_id").distinct()
    for part in (counts, distinct, labels("institutions", "institutions_3y"), labels("countries", "countries_3y"), got):
        out = out.join(part, "tech_id", "left")
    zero = [f"window_{k}" for k in range(OLDER)] + ["n_older", "count_3y", "total", "institutions_3y", "countries_3y", "older_ok", *(f"ok_{k}" for k in range(OLDER))]
    out = out.fillna(0, zero)
    # the oldest window with works says the first date, even where a newer one holds an older date
    filled = [F.when(F.col("n_older") > 0, F.struct(F.col("least_3").alias("d"))), *(F.when(F.col(f"window_{k}") > 0, F.struct(F.col(f"least_{k}").alias("d"))) for k in (2, 1, 0))]
    good = [F.col(f"ok_{k}") > 0 for k in range(OLDER)]
    return out.select(
        "tech_id", *(f"window_{k}" for k in range(OLDER)), "count_3y", "total",
        F.coalesce(*filled)["d"].alias("first_date"),
        (F.greatest(*(f"window_{k}" for k in range(OLDER))) >= CAP).alias("recent_results_capped"),
        (F.col("n_older") >= CAP).alias("older_results_capped"),
        (good[0] & good[1] & good[2] & (F.col("older_ok") > 0)).alias("history_complete"),
        (good[0] & good[1]).alias("recent_3y_complete"),
        "institutions_3y", "countries_3y", "industry_affiliation_share_3y",
        (good[0] | good[1] | good[2] | (F.col("older_ok") > 0)).alias("ok"),
    )


def science_years(works: DataFrame, answers: DataFrame, snapshot: date) -> DataFrame:
    """tech_id, year, n: distinct works by year from the first seen (six years back at least) to the snapshot's; NULL where requests don't cover the year.

    A work counts in the year of its first dated record, the oldest window's first.
    """
    age = F.when(F.col("window") == OLDER, -1).otherwise(F.col("window"))
    dated = _first_works(works, snapshot).where("day is not null")
    years = dated.groupBy("tech_id", "key").agg(F.year(F.min_by("day", age)).alias("year")).groupBy("tech_id", "year").agg(F.count(F.lit(1)).alias("n"))
    spans = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in windows(snapshot)]
    got = _answered(answers).groupBy("tech_id").agg(F.collect_set("window").alias("w"))  # four at most
    techs = answers.select("tech_id").distinct().join(got, "tech_id", "left").join(years.groupBy("tech_id").agg(F.min("year").alias("since")), "tech_id", "left")
    first = F.least(F.coalesce("since", F.lit(snapshot.year)), F.lit(snapshot.year - 5))
    spine = techs.select("tech_id", "w", F.explode(F.sequence(first, F.lit(snapshot.year))).alias("year"))
    begin, end = F.make_date(F.col("year"), F.lit(1), F.lit(1)), F.least(F.make_date(F.col("year"), F.lit(12), F.lit(31)), F.lit(snapshot))
    # the windows lie end to end, so a year is covered if all windows that meet it were answered and it doesn't begin before the first
    met = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), s.alias("s")) for k, s in enumerate(spans))), lambda x: (x["s"]["a"] <= end) & (x["s"]["b"] >= begin))
    covered = (begin >= F.lit(date(1900, 1, 1))) & F.forall(met, lambda x: F.array_contains(F.coalesce("w", F.array().cast("array<int>")), x["k"]))
    return spine.join(years, ["tech_id", "year"], "left").select("tech_id", "year", F.when(covered, F.coalesce("n", F.lit(0))).alias("n"))


FUNDING = ("grant", "funding", "funding_round", "grant_call")
ADOPTION = ("pilot", "deployment", "product", "procurement", "trial", "regulation", "standard_final")
NEWS_TYPES = ("news_agency", "business_press", "press_release")
SCIENCE_TYPES = ("scientific_journal", "open_access", "preprint")


def channel_of(type: Column, channel: Column, provider: Column, connector: Column, event: Column) -> Column:
    """The channel a source counts in; the first rule that fits."""
    type, channel, provider, connector, event = (F.lower(F.coalesce(x, F.lit(""))) for x in (type, channel, provider, connector, event))
    return (
        F.when((type == "patent") | F.contains(provider, F.lit("patent")) | F.contains(connector, F.lit("patent")), "patents")
        .when(event.isin(*FUNDING) | (channel == "money"), "funding")
        .when(F.contains(provider, F.lit("github")) | F.contains(provider, F.lit("huggingface")) | (channel == "community") | (type == "tech_community"), "community")
        .when(event.isin(*ADOPTION) | (channel == "adoption"), "adoption")
        .when((channel == "market") | type.isin(*NEWS_TYPES), "news")
        .when((channel == "science") | type.isin(*SCIENCE_TYPES), "science")
        .otherwise("other")
    )


def fill_channel_years(measured: DataFrame, sources: DataFrame, as_of: date) -> DataFrame:
    """candidate_id, channel, year, n, capped, undated_patents: the measured timelines, unknown years filled from linked sources.

    measured: candidate_id, channel, year, n (NULL: unknown). sources: candidate_id, source_id, status, duplicate_of, type,
    channel, provider, connector, event_type, published_at, event_date. Only read sources that are no duplicates count, one
    for each source_id; only candidates with a patent timeline are filled; news of the last four years is the news query's own.
    A known number, zero included, is never changed. The years grow to all that any source of the candidate lies in,
    sources of channels without a timeline included. capped: sources were added to the patents, so they are a lower bound.
    """
    with_patents = measured.where("channel = 'patents'").select("candidate_id").distinct()
    own = sources.where("status = 'read' AND coalesce(duplicate_of, '') = ''").groupBy("candidate_id", "source_id").agg(
        F.min(F.struct("type", "channel", "provider", "connector", "event_type", "published_at", "event_date")).alias("s")
    ).select("candidate_id", "s.*").join(with_patents, "candidate_id", "left_semi")
    raw = F.coalesce(F.nullif(F.col("published_at"), F.lit("")), F.col("event_date"))
    dated = own.select("candidate_id", channel_of(*map(F.col, ("type", "channel", "provider", "connector", "event_type"))).alias("channel"), F.try_to_date(F.substr(raw, F.lit(1), F.lit(10)), "yyyy-MM-dd").alias("day"))
    undated = dated.groupBy("candidate_id").agg(F.count_if(F.col("day").isNull() & (F.col("channel") == "patents")).alias("undated_patents"))
    timely = dated.where((F.col("day") <= F.lit(as_of)) & ~((F.col("channel") == "news") & (F.col("day") >= F.lit(years_before(as_of, 4)))))
    added = timely.groupBy("candidate_id", "channel", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("added"))
    spans = measured.select("candidate_id", "year").unionByName(added.select("candidate_id", "year")).groupBy("candidate_id").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    capped = added.where("channel = 'patents'").select("candidate_id", "channel", F.lit(True).alias("capped")).distinct()
    spine = measured.select("candidate_id", "channel").distinct().join(spans, "candidate_id").select("candidate_id", "channel", F.explode(F.sequence("a", "b")).alias("year"))
    known = measured.groupBy("candidate_id", "channel", "year").agg(F.max("n").alias("n"))
    key = ["candidate_id", "channel", "year"]
    out = spine.join(known, key, "left").join(added, key, "left").join(capped, key[:2], "left").join(undated, "candidate_id", "left")
    return out.select(*key, F.coalesce("n", "added").alias("n"), F.coalesce("capped", F.lit(False)).alias("capped"), F.when(F.col("channel") == "patents", F.col("undated_patents")).alias("undated_patents"))
