"""Phrases: counts, growth and strata, and nested phrases that say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.dedup import first_survivors


def phrases(words: Column, shortest: int = 2, longest: int = 4) -> Column:
    """All runs of so many words, as an array."""
    parts = []
    for n in range(shortest, longest + 1):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        parts.append(_runs(words, starts, n))
    return F.flatten(F.array(*parts))


def _runs(words: Column, starts: Column, n: int) -> Column:
    def run(i: Column) -> Column:
        return F.array_join(F.slice(words, i, n), " ")

    return F.transform(starts, run)


def phrase_counts(df: DataFrame, text: str) -> DataFrame:
    """phrase, n: two to four Latin words."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([a-z][a-z0-9\-]+)"), F.lit(1))
    return df.select(words.alias("w")).select(F.explode(phrases(F.col("w"))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def strata(counts: DataFrame) -> DataFrame:
    """phrase, recent, base, growth, stratum: growth of recent over base, and whether the volume is over the upper median.

    The median comes from counts by value.
    """
    from pyspark.sql import Window

    by = counts.groupBy("recent").agg(F.count(F.lit(1)).alias("c"))
    run = by.select("recent", F.sum("c").over(Window.orderBy("recent")).alias("upto"), F.sum("c").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("of"))
    median = run.agg(F.min(F.when(F.col("upto") > F.floor(F.col("of") / 2), F.col("recent"))).alias("median"))
    growth = (F.col("recent") + 1) / (F.col("base") + 1)
    big = F.col("recent") > F.col("median")
    stratum = F.when(growth >= 2, F.when(big, "high_volume_rising").otherwise("rising_rare")).when(growth <= 1.2, F.when(big, "established_flat").otherwise("stagnant")).otherwise(F.when(big, "established_flat").otherwise("rising_rare"))
    return counts.crossJoin(F.broadcast(median)).select("phrase", "recent", "base", F.round(growth, 6).alias("growth"), stratum.alias("stratum"))


def collapse_nested(counts: DataFrame) -> DataFrame:
    """Phrases (phrase, n) without those that stand, by whole words, inside a kept longer one of at least 0.6 of their count.

    Longer phrases come first, then frequent ones; nested phrases are met by an equi-join on the longer one's own parts.
    """
    ordered = counts.withColumn("size", F.size(F.split("phrase", " ")))
    ranked = ordered.withColumn("id", F.xxhash64("phrase"))
    words = F.split("phrase", " ")
    inner = ranked.where("size > 2").select(F.col("id").alias("lid"), F.col("n").alias("ln"), F.col("size").alias("lsize"), F.explode(F.array_distinct(phrases(words, 2, 3))).alias("phrase"))
    pairs = inner.join(ranked, "phrase").where((F.col("lsize") > F.col("size")) & (F.col("ln") >= 0.6 * F.col("n")))
    # ids that ascend as the order does: size descending, then the hash; only comparisons between sizes occur
    key = lambda size, h: (F.lit(8) - size) * F.lit(1 << 59) + F.shiftrightunsigned(h, 5)
    items = ranked.select(key(F.col("size"), F.col("id")).alias("id"), "phrase", "n")
    marked = pairs.select(key(F.col("size"), F.col("id")).alias("later"), key(F.col("lsize"), F.col("lid")).alias("earlier"))
    return items.join(first_survivors(items, marked), "id").where("duplicate_of is null").select("phrase", "n")
