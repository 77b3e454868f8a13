"""Duplicates in an order: exact and near copies of documents, similar names, alias groups.

The reference rule compares each item with earlier survivors only. Here matching pairs are found first, by
equi-joins on shingles or words; then survivors are settled in rounds: an item without an open earlier match
survives, an item with a surviving earlier match is its duplicate. Rounds are written to the shared folder; their
number is the longest chain of matches, not the number of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.text import normalized_text
from emberline.session import materialize, release


def first_survivors(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, duplicate_of (NULL for survivors) from items (id) and matching pairs (later, earlier)."""
    spark = items.sparkSession
    edges, _ = materialize(pairs.select("later", "earlier").distinct(), "match-pairs")
    open_, path = materialize(edges.select(F.col("later").alias("id")).distinct(), "open-items")
    settled, settled_path = materialize(spark.createDataFrame([], "id long, duplicate_of long"), "settled-items")
    while open_.limit(1).count():
        mine = edges.join(open_, F.col("later") == F.col("id"), "left_semi")
        known = settled.select(F.col("id").alias("kid"), F.col("duplicate_of").alias("kdup"))
        waiting = open_.select(F.col("id").alias("oid"))
        state = mine.join(known, F.col("earlier") == F.col("kid"), "left").join(waiting, F.col("earlier") == F.col("oid"), "left")
        # an earlier item survives if it was never matched to one before it, or was settled as a survivor
        alive = F.when(F.col("oid").isNotNull(), None).when(F.col("kid").isNotNull(), F.col("kdup").isNull()).otherwise(True)
        by = state.select("later", "earlier", alive.alias("alive")).groupBy("later").agg(F.min(F.when(F.col("alive"), F.col("earlier"))).alias("first"), F.min(F.when(F.col("alive").isNull(), F.col("earlier"))).alias("unsure"))
        # settled when the first survivor comes before anything still open, or nothing is open
        ready = by.where(F.col("unsure").isNull() | (F.col("first") < F.col("unsure")))
        new, new_path = materialize(settled.unionByName(ready.select(F.col("later").alias("id"), F.col("first").alias("duplicate_of"))), "settled-items")
        rest, rest_path = materialize(open_.join(new, "id", "left_anti"), "open-items")
        release(spark, path)
        release(spark, settled_path)
        open_, path, settled, settled_path = rest, rest_path, new, new_path
    return items.select("id").join(settled, "id", "left")


def stride_shingles(text: Column, words: int = 5, stride: int = 3, most: int | None = None) -> tuple[Column, Column]:
    """The words, and distinct hashes of runs of words at every third place, over the whole text or its first `most` words (the reference's rule: 5000)."""
    own = F.split(normalized_text(text), " ", -1)
    if most is not None:
        own = F.slice(own, 1, most)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("__w") - words, F.lit(0)), F.lit(stride)), lambda i: i + words <= F.size("__w"))
    return own, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("__w", i + 1, words), " "))))


def shingled(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, content_hash, shingles."""
    words, hashes = stride_shingles(F.col(text))
    return docs.select(F.col(id_).alias("id"), F.sha2(normalized_text(F.col(text)), 256).alias("content_hash"), words.alias("__w")).select("id", "content_hash", hashes.alias("shingles"))


def overlap_pairs(shingles: DataFrame, least: int = 40, limit: float = 0.82) -> DataFrame:
    """later, earlier, overlap: distinct texts whose shared shingles are over `limit` of the smaller set, the later with over `least`.

    Exact copies are one text here (the first), so copies don't multiply pairs. A smaller set of n shingles has over
    limit * n of them in the larger, so one of its n - floor(limit * n) rarest is among them: only these probe the larger
    sets, and a shingle that very many texts hold is probed by texts alone that hold little else.
    """
    first = shingles.groupBy("content_hash").agg(F.min("id").alias("id"), F.min_by("shingles", "id").alias("shingles")).select("id", "shingles", F.size("shingles").alias("n"))
    first, _ = materialize(first, "distinct-texts")
    long = first.select("id", "n", F.explode("shingles").alias("h"))
    counted = long.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    # shingles of one text alone take the first places and probe nothing; how many there are is n less those met here
    met = long.join(counted, "h")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("texts", "h")) + F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("id"))
    probes = met.withColumn("__rank", rank).where(F.col("__rank") <= F.col("n") - F.floor(F.col("n") * limit - 1e-9)).select("h", F.col("id").alias("small"), F.col("n").alias("ns"))
    others = met.select("h", F.col("id").alias("large"), F.col("n").alias("nl"))
    fits = (F.col("nl") > F.col("ns")) | ((F.col("nl") == F.col("ns")) & (F.col("large") < F.col("small")))
    later_size = F.when(F.col("small") > F.col("large"), F.col("ns")).otherwise(F.col("nl"))
    tried = probes.join(others, "h").where(fits & (later_size > least)).select("small", "large").distinct()
    sets = first.select("id", "shingles")
    both = tried.join(sets.select(F.col("id").alias("small"), F.col("shingles").alias("a")), "small").join(sets.select(F.col("id").alias("large"), F.col("shingles").alias("b")), "large")
    share = F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.lit(1))
    ends = both.select(F.greatest("small", "large").alias("later"), F.least("small", "large").alias("earlier"), share.alias("share"))
    return ends.where(F.col("share") > limit).select("later", "earlier", F.round("share", 6).alias("overlap"))


def near_duplicates(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, duplicate_of: exact copies and near copies of earlier survivors, in the order of id.

    A text is compared once; its exact copies follow its first document.
    """
    marks, _ = materialize(shingled(docs, id_, text), "document-shingles")
    first = marks.groupBy("content_hash").agg(F.min("id").alias("rep"))
    kept = first_survivors(first.select(F.col("rep").alias("id")), overlap_pairs(marks)).select(F.col("id").alias("rep"), "duplicate_of")
    named = marks.select("id", "content_hash").join(first, "content_hash").join(kept, "rep")
    return named.select("id", F.coalesce("duplicate_of", F.when(F.col("id") != F.col("rep"), F.col("rep"))).alias("duplicate_of"))


def matched_earlier(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, is_duplicate: whether a document repeats or nearly repeats an earlier text, be that one itself a duplicate or not.

    near_duplicates compares with survivors alone: a text whose only matches are duplicates survives there, and is one here.
    """
    marks, _ = materialize(shingled(docs, id_, text), "document-shingles")
    first = marks.groupBy("content_hash").agg(F.min("id").alias("rep"))
    matched = overlap_pairs(marks).select(F.col("later").alias("rep"), F.lit(True).alias("matched")).distinct()
    named = marks.select("id", "content_hash").join(first, "content_hash").join(matched, "rep", "left")
    return named.select("id", ((F.col("id") != F.col("rep")) | F.col("matched").isNotNull()).alias("is_duplicate"))


def word_pairs(items: DataFrame, words: str, rule: Column, least: float = 0.5, neighbours: bool = True) -> DataFrame:
    """later, earlier of items (id, words array) that satisfy rule over columns a, b (words of the earlier and the later).

    The rule must ask for a Jaccard similarity of at least `least`, for one set within the other or, with neighbours, for two
    neighbouring words in common. At that similarity a set of n words shares 2 * n * least / (1 + least) with one no smaller,
    so one of its rarest words is shared: only these probe, and a word that all items hold is probed by items of little else.
    """
    own = items.select("id", F.col(words).alias("w"), F.array_distinct(words).alias("s"))
    by_word = own.select("id", F.size("s").alias("n"), F.explode("s").alias("word"))
    ranked = by_word.join(by_word.groupBy("word").agg(F.count(F.lit(1)).alias("items")), "word").withColumn("__rank", F.row_number().over(Window.partitionBy("id").orderBy("items", "word")))
    probes = ranked.where(F.col("__rank") <= F.col("n") - F.ceil(F.col("n") * (2 * least / (1 + least)) - 1e-9) + 1).select("word", F.col("id").alias("x"), F.col("n").alias("nx"))
    met = probes.join(by_word.select("word", F.col("id").alias("y"), "n"), "word").where((F.col("x") != F.col("y")) & (F.col("n") >= F.col("nx"))).select("x", "y")
    if neighbours:
        two = own.where(F.size("w") > 1).select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " ")))).alias("two"))
        met = met.unionByName(two.select("two", F.col("id").alias("x")).join(two.select("two", F.col("id").alias("y")), "two").where("x < y").select("x", "y"))
    pairs = met.select(F.greatest("x", "y").alias("id"), F.least("x", "y").alias("earlier")).distinct()
    full = pairs.join(own.select("id", F.col("w").alias("b")), "id").join(own.select(F.col("id").alias("earlier"), F.col("w").alias("a")), "earlier")
    return full.where(rule).select(F.col("id").alias("later"), "earlier")


def technology_links(items: DataFrame, words: str) -> DataFrame:
    """later, earlier: links that connect the items (id, words) of one technology, and only those, without all of their pairs.

    Items with two neighbouring words in common are linked to the first of them, so two words that very many items hold give as
    many links as items. The other rules ask for rare words in common (word_pairs).
    """
    own = items.select("id", F.col(words).alias("w")).where(F.size("w") > 1)
    two = own.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " ")))).alias("two"))
    first = two.groupBy("two").agg(F.min("id").alias("earlier"))
    stars = two.join(first, "two").where("id <> earlier").select(F.col("id").alias("later"), "earlier").distinct()
    return stars.unionByName(word_pairs(items, words, same_technology(F.col("a"), F.col("b")), neighbours=False))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def same_technology(a: Column, b: Column) -> Column:
    """Half of the words shared, one within the other, or a pair of neighbouring words in common."""
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    inter = F.size(F.array_intersect(sa, sb))
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, i, 2), " "))).otherwise(F.array().cast("array<string>"))
    return (F.size(sa) > 0) & (F.size(sb) > 0) & ((jaccard(sa, sb) >= 0.5) | (inter == F.size(sa)) | (inter == F.size(sb)) | F.arrays_overlap(pairs(a), pairs(b)))


def merge_aliases(rows: DataFrame) -> DataFrame:
    """Rows (id, term, alias_of, label, ours): terms and aliases become one group; contradicting groups go; of each group one row stays, ours first, then the smallest id."""
    owners = rows.select(F.col("term").alias("owner")).distinct()
    grouped = rows.join(owners, F.col("alias_of") == F.col("owner"), "left").withColumn("term_group", F.coalesce("owner", "term")).drop("owner")
    flags = grouped.groupBy("term_group").agg((F.count_distinct("label") > 1).alias("contradicts"), F.array_sort(F.collect_set("term")).alias("aliases"))
    ranked = grouped.join(flags, "term_group").where(~F.col("contradicts")).withColumn("__rn", F.row_number().over(Window.partitionBy("term_group").orderBy(F.col("ours").desc(), "id")))
    return ranked.where("__rn = 1").drop("__rn", "contradicts")
