"""Phrases whose stems stand close together in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 3  # stems of a way at most


def chosen(items: Column, n: Column) -> Column:
    """All ways to take n of 1 to SEED items, in their order."""
    after = lambda x: F.filter(items, lambda y: y > x)
    one = F.transform(items, lambda x: F.array(x))
    two = F.flatten(F.transform(items, lambda x: F.transform(after(x), lambda y: F.array(x, y))))
    three = F.flatten(F.transform(items, lambda x: F.flatten(F.transform(after(x), lambda y: F.transform(after(y), lambda z: F.array(x, y, z))))))
    return F.when(n == 1, one).when(n == 2, two).when(n == SEED, three)


def within(around: Column, k: Column, need: Column, window: int) -> Column:
    """need of the stems k stand in one run of `window` places, around (array of place, stem) holding the runs over place 0."""
    held = lambda places: F.size(F.array_intersect(k, F.transform(places, lambda x: x["stem"]))) >= need
    starts = F.array(*[F.lit(i) for i in range(1 - window, 1)])
    return F.when(held(around), F.exists(starts, lambda i: held(F.filter(around, lambda x: (x["place"] >= i) & (x["place"] < i + window))))).otherwise(False)


def near_pairs(docs: DataFrame, items: DataFrame, min_share: float = 0.6, window: int = 12) -> DataFrame:
    """doc_id, item_id, one row for each pair of rows of docs (doc_id, s: stems in order) and items (item_id, k: distinct stems)
    with min_share (above 0) of k within some run of `window` stems of s. An item of any size is met whole.

    Where an item needs m of its n stems, a run that holds them holds 3 (or m, if fewer) of any n - m + 3: here those that the
    fewest items have. Such a run begins with one of them; the others follow it in any order. So every stem of a text is met
    with the first stems of all ways to take 3 of those, then with the next one from the run after it in alphabetical order,
    and so on: rows are bounded by the places of the texts, however many items share a stem. A way of m stems is a match; of
    a larger item the runs around it are counted with all its stems. Items of the same stems are one until the end.
    """
    spelled = lambda *words: F.concat_ws(" ", *words)  # noqa: E731  (stems hold no space)
    need = F.ceil(F.size("k") * min_share - 1e-9).cast("int")
    items = items.where(F.size("k") > 0).select("item_id", F.array_sort("k").alias("k")).withColumn("phrase", spelled("k"))
    phrases = items.select("phrase", "k", need.alias("need")).where(F.col("need") <= window).distinct()  # a run has no more stems
    stems = phrases.select("phrase", "need", F.explode("k").alias("stem"))
    common = stems.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    rare = F.transform(F.array_sort(F.collect_list(F.struct("n", (-F.length("stem")).alias("long"), "stem"))), lambda x: x["stem"])
    ways = stems.join(common, "stem").groupBy("phrase", "need").agg(rare.alias("rare")).withColumn("seed", F.least("need", F.lit(SEED)))
    some = F.array_sort(F.slice("rare", F.lit(1), F.size("rare") - F.col("need") + F.col("seed")))
    ways = ways.select("phrase", "need", F.array_sort("rare").alias("k"), F.explode(chosen(some, F.col("seed"))).alias("way"))
    ways = ways.select("phrase", "need", "k", F.explode("way").alias("first"), "way").select("phrase", "need", "k", "first", F.array_remove("way", F.col("first")).alias("others"))
    ways = ways.withColumn("two", spelled("first", F.get("others", F.lit(0)))).withColumn("key", spelled("first", "others"))
    firsts = ways.select(F.col("first").alias("stem"), F.lit(True).alias("leads")).distinct()
    wanted = common.join(firsts, "stem", "left").select("stem", F.coalesce("leads", F.lit(False)).alias("leads"))
    twos = ways.groupBy("two").agg(F.max(F.size("others") > 1).alias("more"))
    keys = ways.groupBy("key").agg(F.max(F.col("need") > SEED).alias("larger"))

    # only stems that some phrase asks for are sorted by place; a row of a run holds the leading stems from its place on
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "s")
    places = own.select("row", "doc_id", F.posexplode("s").alias("at", "stem")).join(wanted, "stem")
    by_place = Window.partitionBy("row").orderBy("at")
    run = F.collect_list(F.when(F.col("leads"), F.col("stem"))).over(by_place.rangeBetween(0, window - 1))
    around = F.collect_list(F.struct("at", "stem")).over(by_place.rangeBetween(1 - window, window - 1))
    begun = places.select("row", "doc_id", "at", "stem", "leads", run.alias("run"), around.alias("around")).where("leads")
    begun = begun.select("row", "doc_id", "at", F.col("stem").alias("first"), F.array_except("run", F.array("stem")).alias("rest"), "around")
    none = F.array(F.lit(None).cast("string"))
    second = begun.select("row", "doc_id", "at", "first", "rest", "around", F.explode(F.concat(none, "rest")).alias("second")).withColumn("two", spelled("first", "second")).join(twos, "two")
    later = F.when(F.col("more") & F.col("second").isNotNull(), F.filter("rest", lambda x: x > F.col("second"))).otherwise(F.array().cast("array<string>"))
    third = second.select("row", "doc_id", "at", "two", "around", F.explode(F.concat(none, later)).alias("third")).select("row", "doc_id", "at", spelled("two", "third").alias("key"), "around")
    told = F.transform("around", lambda x: F.struct((x["at"] - F.col("at")).alias("place"), x["stem"].alias("stem")))  # equal surroundings are looked at once
    held = third.join(keys, "key").select("row", "doc_id", "key", F.when(F.col("larger"), told).alias("around")).distinct()
    met = held.join(ways.select("key", "phrase", "need", "k"), "key").where((F.col("need") <= SEED) | within(F.col("around"), F.col("k"), F.col("need"), window))
    return met.select("row", "doc_id", "phrase").distinct().join(items.select("phrase", "item_id"), "phrase").select("doc_id", "item_id")
