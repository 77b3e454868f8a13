"""Candidates with nearly the same name: sequence ratios of pairs that share enough, merged in order.

A ratio over r needs lengths within r / (2 - r) of each other and many pairs of neighbouring signs in common, so items
meet by the rarest of these, or by bands of length where r is too small to promise any: no pair over the ratio is lost. The
ratio itself is the standard library's, in Arrow batches, and only where the signs in common, whatever their order, allow it.
"""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from emberline.functions.columns import let
from emberline.operators.dedup import first_survivors


def ratio_over(least: float):
    """SequenceMatcher(None, later, earlier).ratio(), or 0 where the signs in common show that it is below `least`. It isn't symmetric, the later item comes first."""

    @F.pandas_udf(DoubleType())
    def ratio(later: pd.Series, earlier: pd.Series) -> pd.Series:
        out, held = [], {}
        for a, b in zip(later, earlier, strict=True):
            x, y = (held.setdefault(k, Counter(k)) for k in (a, b))
            may = 2 * (x & y).total() >= least * (len(a) + len(b))
            out.append(SequenceMatcher(None, a, b).ratio() if may else 0.0)
        return pd.Series(out, dtype="float64")

    return ratio


def numbered_pairs(key: Column) -> Column:
    """Each two neighbouring signs, with how often they stood before: a bag as a set."""
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1))), lambda i: F.substr(key, i, F.lit(2)))
    own = F.when(F.length(key) > 1, two).otherwise(F.array().cast("array<string>"))
    return let(own, lambda g: F.transform(g, lambda x, i: F.concat(x, F.size(F.filter(F.slice(g, 1, i), lambda y: y == x)).cast("string"))))


def similar_pairs(items: DataFrame, least: float = 0.86) -> DataFrame:
    """later, earlier, ratio of items (id, key) with a ratio over `least`, which must be over 2 / 3.

    With S signs in both, at least least * S / 2 are matched and at most (1 - least) * S are not; matched runs are parted by at least
    one unmatched sign, so all but (1 - least) * S + 1 matched signs begin a pair of neighbours that both have. The shorter
    key of n signs therefore shares (3 * least - 2) * n - 1 of its pairs, and one of its rarest is among them. Where that is
    none (keys of one sign at 0.86), keys meet by single signs instead; equal keys meet by the key.
    """
    if least <= 2 / 3:
        raise ValueError("a ratio of 2 / 3 or less promises no pair of neighbours in common")
    own = items.select("id", "key", F.length("key").alias("n"))
    grams = own.select("id", "n", F.explode(numbered_pairs(F.col("key"))).alias("g"))
    counted = grams.join(grams.groupBy("g").agg(F.count(F.lit(1)).alias("items")), "g")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("items", "g"))
    shared = F.ceil(F.col("n") * (3 * least - 2) - 1 - 1e-9)
    probes = counted.withColumn("at", rank).where((shared >= 1) & (F.col("at") <= F.col("n") - 1 - shared + 1)).select("g", F.col("id").alias("x"), F.col("n").alias("nx"))
    met = probes.join(grams.select("g", F.col("id").alias("y"), F.col("n").alias("ny")), "g")
    longest = math.floor(1 / (3 * least - 2) + 1e-9)  # of keys that promise no pair
    signs = own.where(F.col("n").between(1, math.floor(longest * (2 - least) / least + 1e-9))).select("id", "n", F.explode(F.array_distinct(F.split("key", ""))).alias("c"))
    met = met.unionByName(signs.where(F.col("n") <= longest).select("c", F.col("id").alias("x"), F.col("n").alias("nx")).join(signs.select("c", F.col("id").alias("y"), F.col("n").alias("ny")), "c").withColumnRenamed("c", "g"))
    met = met.where((F.col("x") != F.col("y")) & (F.col("ny") >= F.col("nx")) & (2 * F.col("nx") >= least * (F.col("nx") + F.col("ny"))))
    same = own.select("key", F.col("id").alias("x")).join(own.select("key", F.col("id").alias("y")), "key").where("x < y")
    tried = met.select("x", "y").unionByName(same.select("x", "y")).select(F.greatest("x", "y").alias("id"), F.least("x", "y").alias("earlier")).distinct()
    both = tried.join(own.select("id", "key"), "id").join(own.select(F.col("id").alias("earlier"), F.col("key").alias("k2")), "earlier")
    return both.withColumn("ratio", ratio_over(least)("key", "k2")).where(F.col("ratio") > least).select(F.col("id").alias("later"), "earlier", "ratio")


def merge_candidates(items: DataFrame, limit: int, least: float = 0.86) -> DataFrame:
    """id, action (kept, merged_duplicate, limit_excluded), merged_into, source_ids, for every item (id, key, source_ids).

    In the order of id: an item close to an earlier kept one is merged into it, with its sources; of the others the
    first `limit` are kept. What the limit leaves out can't take in duplicates, so those of it are tried on.
    """
    pairs = similar_pairs(items, least)
    settled = first_survivors(items, pairs).select("id", "duplicate_of")
    kept = settled.where("duplicate_of is null").orderBy("id").limit(limit).select(F.col("id").alias("kid"))
    out = items.join(settled, "id").join(F.broadcast(kept), F.coalesce("duplicate_of", "id") == F.col("kid"), "left")
    action = F.when(F.col("kid").isNull(), "limit_excluded").when(F.col("duplicate_of").isNotNull(), "merged_duplicate").otherwise("kept")
    out = out.select("id", action.alias("action"), F.when(F.col("kid").isNotNull(), F.col("duplicate_of")).alias("merged_into"), "source_ids", F.coalesce("kid", "id").alias("leader"))
    sources = out.select("leader", F.explode_outer("source_ids").alias("s")).groupBy("leader").agg(F.array_sort(F.collect_set("s")).alias("all_sources"))
    return out.join(sources, "leader").select("id", "action", "merged_into", F.when(F.col("action") == "kept", F.col("all_sources")).otherwise(F.col("source_ids")).alias("source_ids"))


def best_match(items: DataFrame, others: DataFrame, least: float = 0.68) -> DataFrame:
    """id, best (NULL under `least`), represented: the highest ratio of each item (id, key) to others (key), met by length bands."""
    step = -math.log(least / (2 - least))
    band = lambda k: F.floor(F.log(F.greatest(F.length(k), F.lit(1)).cast("double")) / step).cast("int")
    own = items.select("id", "key", band("key").alias("band"))
    other = others.select(F.col("key").alias("k2")).distinct()
    other = other.select("k2", F.explode(F.array(band("k2") - 1, band("k2"), band("k2") + 1)).alias("band"))
    best = own.join(other, "band").withColumn("r", ratio_over(least)("key", "k2")).where(F.col("r") >= least).groupBy("id").agg(F.max("r").alias("best"))
    return items.select("id").join(best, "id", "left").withColumn("represented", F.col("best").isNotNull())


def water_fill(counts: dict[str, int], total: int) -> dict[str, int]:
    """Quotas by domain (a dimension, on the driver): equal shares, what small domains leave going to the others."""
    quotas, open_ = dict.fromkeys(counts, 0), {k for k, v in counts.items() if v}
    left = total
    while left > 0 and open_:
        share = max(1, left // len(open_))
        for k in sorted(open_):
            give = min(share, counts[k] - quotas[k], left)
            quotas[k] += give
            left -= give
        open_ = {k for k in open_ if quotas[k] < counts[k]}
    return quotas


def select_by_quota(rows: DataFrame, domain: str, order: list, quotas: dict[str, int]) -> DataFrame:
    limits = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(domain).orderBy(*order)))
    return ranked.where(F.col("__rn") <= F.coalesce(F.try_element_at(limits, F.col(domain)), F.lit(0))).drop("__rn")
