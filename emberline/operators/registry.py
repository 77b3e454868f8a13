"""Source trust: by address pattern, then the longest listed domain, then domain ending, then a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.urls import host_of, host_suffixes

TRUST = {"official": "high", "journal": "high", "news": "medium", "press_release": "low", "blog": "low", "social": "low", "website": "unverified"}
PRIMARY_ONLY = ("blog", "social")


def override(domains: DataFrame, edits: DataFrame) -> DataFrame:
    """domains (domain, type) with edits (domain, type; type NULL deletes) applied."""
    return domains.join(edits, "domain", "left_anti").unionByName(edits.where("type is not null"))


def classify(rows: DataFrame, url: str, domains: DataFrame, patterns: list[tuple[str, str]], endings: list[tuple[str, str]]) -> DataFrame:
    """Adds host, type, trust, primary_only, matched. domains: one row a listed domain (domain, type).

    Distinct hosts alone are joined to the list, by each of their parent domains.
    """
    rows = rows.withColumn("host", host_of(F.col(url)))
    hosts = rows.select("host").distinct()
    listed = domains.select(F.col("domain").alias("suffix"), F.col("type").alias("listed"))
    found = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("suffix")).join(listed, "suffix")
    best = found.groupBy("host").agg(F.max_by(F.struct("listed", "suffix"), F.length("suffix")).alias("best"))
    rows = rows.join(best, "host", "left")
    kind, matched = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, name in reversed(patterns):
        hit = F.lower(F.col(url)).rlike(pattern)
        kind, matched = F.when(hit, name).otherwise(kind), F.when(hit, pattern).otherwise(matched)
    ending, by = F.lit("website"), F.lit(None).cast("string")
    for suffix, name in reversed(endings):
        hit = F.col("host").endswith(suffix) | (F.col("host") == suffix.lstrip("."))
        ending, by = F.when(hit, name).otherwise(ending), F.when(hit, "*" + suffix).otherwise(by)
    type_ = F.coalesce(kind, F.col("best.listed"), ending)
    matched = F.when(kind.isNotNull(), matched).when(F.col("best").isNotNull(), F.col("best.suffix")).otherwise(by)
    trust = F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])
    return rows.withColumns({"type": type_, "matched": matched}).withColumns({"trust": F.element_at(trust, F.col("type")), "primary_only": F.col("type").isin(*PRIMARY_ONLY)}).drop("best")


def supports(sources: DataFrame, item: str) -> DataFrame:
    """item, n_sources, supported, single_host, low_trust: a signal needs one independent source that is no press release."""
    independent = ~F.col("primary_only") & (F.col("type") != "press_release")
    by = sources.groupBy(item).agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_distinct(F.when(independent, F.col("host"))).alias("n_hosts"), F.max(independent & F.col("trust").isin("high", "medium")).alias("trusted")
    )
    return by.select(item, "n_sources", (F.col("n_hosts") > 0).alias("supported"), (F.col("n_hosts") == 1).alias("single_host"), ((F.col("n_hosts") > 0) & ~F.col("trusted")).alias("low_trust"))


def supports_column() -> Column:
    return F.col("supported")
