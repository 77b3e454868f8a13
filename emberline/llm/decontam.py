"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Only built-in functions. Words are lower-cased runs of letters and digits; shingles are five words (all words
of an item that has fewer), and a shingle's weight is how often it occurs. A document holds an item if a
window of as many words as the item has (or the whole document, if shorter) has a weighted similarity to it
(sum of smaller weights over sum of larger ones) of at least `similarity`.

1. Which windows are looked at. A window that similar misses at most r of an item's m shingles, so among any r + 1 of them
   it has one. The r + 1 that fewest items share (ties by hash) are the item's seeds. Documents' shingles are joined to the
   seeds, and where they meet, every window of that item's size that holds the meeting shingle is looked at, wherever the
   item has it: similarity is over bags, so a window may hold the item's parts in another order. A window without any
   seed misses r + 1 of every item's shingles and can't be similar, so none is lost.
2. Which items a window meets. It gets a 64-bit SimHash of its shingles and is sought in an index of all items of its size:
   four blocks of 16 bits. Fingerprints within `radius` bits differ by at most a quarter of that in one block at least; the
   index holds the Hamming ball around each item's block but for one bit, and a window asks for the ball of one bit around its
   own, so every pair within the radius meets. It is the blocks that find items: a seed says where to look, not for what.
   Distances are completed, and the weighted similarity of what is left is worked out from the shingles.

Items of any length: counters of fingerprints widen where an item has over 65,535 shingles, windows are cut one by one from the part of
the document that is asked for, and the similarity takes time in proportion to a window.

Seeds are broadcast in blocks of items with about seeds_per_block seeds each, the index in blocks of index_rows rows (an item
has 2,788), so what is broadcast has a fixed bound (some 30 and 170 MB); a larger benchmark takes more blocks. Documents with a seed are broadcast
back to their texts where they are few (at most few_docs), and joined by a shuffle otherwise.

Null texts count as empty, items without words match nothing, rows without doc_id or item_id are left out,
repeated rows count once, empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import let
from emberline.llm.common import slim, without_ids
from emberline.llm.fingerprints import long, shingle_hashes
from emberline.session import materialize

WORDS = 5


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def simhash(hashes: str, width: int = 16) -> Column:
    """Bit 1 where over half of a column's hashes have it, as one SQL expression. Counters of `width` bits, as many to a long as fit: 16 bits count up to 65,535 hashes, 32 bits any array."""
    lanes, full = 64 // width, (1 << width) - 1
    ones = sum(1 << width * lane for lane in range(lanes))
    counts = ", ".join(f"aggregate({hashes}, 0L, (n, h) -> n + (shiftrightunsigned(h, {k}) & {ones}L))" for k in range(width))
    bits = [f"if((shiftrightunsigned(c[{k}], {width * lane}) & {full}L) * 2 > size({hashes}), shiftleft(1L, {width * lane + k}), 0L)" for k in range(width) for lane in range(lanes)]
    return F.expr(f"transform(array(array({counts})), c -> {' | '.join(bits)})[0]")


def weighted_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of shingles as bags: shared occurrences over all.

    A hash that both hold k times at least counts k times: once for every round in which, after one of each hash has been taken
    out of both sorted arrays, both still have it. Most bags repeat nothing and are done in one round.
    """

    def repeats(x: Column) -> Column:
        return F.filter(x, lambda v, i: (i > 0) & (v == F.get(x, i - 1)))

    def shared(s: Column) -> Column:
        def add(state: Column, _: Column) -> Column:
            done = (F.size(state["x"]) == 0) | (F.size(state["y"]) == 0)
            return F.struct(
                F.when(done, state["x"]).otherwise(repeats(state["x"])).alias("x"),
                F.when(done, state["y"]).otherwise(repeats(state["y"])).alias("y"),
                (state["n"] + F.when(done, F.lit(0)).otherwise(F.size(F.array_intersect(state["x"], state["y"])))).alias("n"),
            )

        rounds = 1 + F.least(F.size(repeats(s["x"])), F.size(repeats(s["y"])))
        begin = F.struct(s["x"].alias("x"), s["y"].alias("y"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), rounds), begin, add, lambda state: state["n"])

    both = let(F.struct(F.sort_array(a).alias("x"), F.sort_array(b).alias("y")), shared)
    return let(both, lambda n: n / (F.size(a) + F.size(b) - n))


def _missing(m: Column, similarity: float) -> Column:
    """The most of m shingles that a window at this similarity can miss (it may have fewer shingles than m, never more)."""
    return m - F.ceil(m * similarity - 1e-9).cast("int")


BLOCKS, BLOCK_BITS = 4, 16


def _segments(fp: str) -> Column:
    return F.expr("array(" + ", ".join(f"shiftrightunsigned({fp}, {BLOCK_BITS * k}) & {(1 << BLOCK_BITS) - 1}L" for k in range(BLOCKS)) + ")")


def _ball(value: str, reach: int) -> Column:
    """All values that differ from a block's in at most `reach` bits."""
    masks = [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(BLOCK_BITS), n)]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.col(value).bitwiseXOR(m))


def _table(rows: DataFrame, fp: str, reach: int, *columns: str) -> DataFrame:
    """block, key and columns: a row for each value of the balls around a fingerprint's blocks."""
    return rows.select(*columns, F.posexplode(_segments(fp)).alias("block", "value")).select(*columns, "block", F.explode(_ball("value", reach)).alias("key"))


def near_items(windows: DataFrame, own: DataFrame, radius: int, index_rows: int = 1 << 20) -> DataFrame:
    """n_words, fp, item_key: items (n_words, item_key, item_fp) of a window's size whose fingerprints are within radius of the window's (n_words, fp)."""
    reach = radius // BLOCKS
    theirs = max(0, reach - 1)
    per_item = BLOCKS * sum(comb(BLOCK_BITS, k) for k in range(theirs + 1))
    n = max(1, -(-own.count() * per_item // index_rows))
    asked = _table(windows.select("n_words", "fp").distinct(), "fp", reach - theirs, "n_words", "fp")
    part = F.pmod(F.xxhash64("item_key"), F.lit(n))
    found = []
    for k in range(n):
        index = _table(own.where(part == k), "item_fp", theirs, "n_words", "item_key", "item_fp")
        met = asked.join(F.broadcast(index), ["n_words", "block", "key"])
        found.append(met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("n_words", "fp", "item_key").distinct())
    return reduce(DataFrame.unionByName, found)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 19, seeds_per_block: int = 1 << 17, few_docs: int = 1 << 16) -> DataFrame:
    """doc_id, item_id, similarity (the best window's), window_start (its first word), n_words (of the item)."""
    spark = docs.sparkSession
    words = normal_words(F.coalesce(F.col("text"), F.lit("")))
    items = (
        benchmark.where(F.col("item_id").isNotNull())
        .select(F.col("item_id").cast("long").alias("item_id"), words.alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", F.size("words").alias("n_words"), F.least(F.size("words"), F.lit(WORDS)).alias("width"), "words")
    )
    kinds = [r["width"] for r in items.select("width").distinct().collect()]  # at most five
    found = [_contaminated(docs, items, width, similarity, radius, seeds_per_block, few_docs) for width in sorted(kinds)]
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, window_start int, n_words int")
    pairs = reduce(DataFrame.unionByName, found)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("b")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.similarity", (-F.col("b.s")).alias("window_start"), F.col("b.n_words").alias("n_words"))


def _contaminated(docs: DataFrame, items: DataFrame, width: int, similarity: float, radius: int, seeds_per_block: int, few_docs: int) -> DataFrame:
    own = items.where(F.col("width") == width).select("item_id", "n_words", shingle_hashes(F.col("words"), width).alias("item_shingles")).dropDuplicates(["item_id", "item_shingles"])
    own = own.withColumn("item_key", F.xxhash64("item_id", "item_shingles")).withColumn("miss", _missing(F.size("item_shingles"), similarity))
    own, _ = materialize(own, "items")
    counter = 16 if (own.agg(F.max(F.size("item_shingles")).alias("n")).first()["n"] or 0) < 1 << 16 else 32  # windows are no longer than items
    own, _ = materialize(own.withColumn("item_fp", simhash("item_shingles", counter)), "items")
    places = own.select("item_key", "n_words", "miss", F.explode("item_shingles").alias("h"))
    rare = places.groupBy("h").agg(F.count_distinct("item_key").alias("items"))
    ordered = places.join(rare, "h").groupBy("item_key", "n_words", "miss").agg(F.array_sort(F.collect_list(F.struct("items", "h"))).alias("ordered"))
    seeds = ordered.select("item_key", "n_words", F.explode(F.array_distinct(F.transform(F.slice("ordered", 1, F.col("miss") + 1), lambda x: x["h"]))).alias("h"))
    seeds, _ = materialize(seeds, "seeds")
    n_blocks = max(1, -(-seeds.count() // seeds_per_block))
    block = F.pmod(F.xxhash64("item_key"), F.lit(n_blocks))
    found = [_scan(docs, own.where(block == k), seeds.where(block == k), width, similarity, radius, few_docs, counter) for k in range(n_blocks)]
    return reduce(DataFrame.unionByName, found)


def _merged(hits: Column) -> Column:
    """Ranges of starts (low, high), both of which ascend together, without what an earlier one covers."""

    def rest(x: Column, i: Column) -> Column:
        return F.struct(F.greatest(x["low"], F.when(i > 0, F.get(hits, i - 1)["high"] + 1).otherwise(F.lit(0))).alias("low"), x["high"].alias("high"))

    return F.filter(F.transform(hits, rest), lambda x: x["low"] <= x["high"])


def _scan(docs: DataFrame, own: DataFrame, seeds: DataFrame, width: int, similarity: float, radius: int, few_docs: int, counter: int) -> DataFrame:
    texts = slim(docs).select("doc_id", shingle_hashes(normal_words(F.col("text")), width).alias("shingles"))
    rows = texts.select("doc_id", F.size("shingles").alias("n"), F.posexplode("shingles").alias("pos", "h"))
    last = F.greatest(F.col("n") + width - 1 - F.col("n_words"), F.lit(0))  # start of the last window of n_words words
    low = F.least(F.greatest(F.col("pos") - F.col("n_words") + width, F.lit(0)), last)
    hits = rows.join(F.broadcast(seeds), "h").select("doc_id", "n_words", F.struct(low.alias("low"), F.least(F.col("pos"), last).alias("high")).alias("hit"))
    by_size = hits.groupBy("doc_id", "n_words").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    asked = by_size.select("doc_id", F.struct("n_words", _merged(F.col("hits")).alias("ranges")).alias("asked")).groupBy("doc_id").agg(F.collect_list("asked").alias("asked"))
    asked, _ = materialize(asked, "windows")

    def cut(wanted: DataFrame) -> DataFrame:
        """The shingles of the documents named, with wanted's columns: the join comes first, so only these are cut again."""
        few = wanted.count() <= few_docs
        held = slim(docs).join(F.broadcast(wanted) if few else wanted, "doc_id")
        return held.select(*wanted.columns, shingle_hashes(normal_words(F.col("text")), width).alias("shingles"))

    m = F.col("n_words") - width + 1
    ranges = cut(asked).select("doc_id", "shingles", F.explode("asked").alias("a")).select("doc_id", "shingles", "a.n_words", F.explode("a.ranges").alias("r"))
    parts = ranges.select("doc_id", "n_words", "r.low", "r.high", F.slice("shingles", F.col("r.low") + 1, F.col("r.high") - F.col("r.low") + m).alias("part"))
    starts = parts.select("doc_id", "n_words", "low", "part", F.explode(F.sequence("low", "high")).alias("start"))
    windows = starts.select("doc_id", "n_words", "start", F.slice("part", F.col("start") - F.col("low") + 1, m).alias("window")).where(F.size("window") > 0)
    marked, _ = materialize(windows.select("doc_id", "n_words", "start", simhash("window", counter).alias("fp")), "window-fingerprints")
    near, _ = materialize(near_items(marked, own, radius), "near-items")
    pairs = marked.join(near, ["n_words", "fp"]).groupBy("doc_id").agg(F.collect_list(F.struct("n_words", "start", "item_key")).alias("pairs"))
    pairs, _ = materialize(pairs, "window-pairs")
    tried = cut(pairs).select("doc_id", "shingles", F.explode("pairs").alias("p")).select("doc_id", "p.*", F.slice("shingles", F.col("p.start") + 1, F.col("p.n_words") - width + 1).alias("window"))
    scored = tried.join(own.select("item_key", "item_id", "item_shingles"), "item_key")
    scored = scored.select("doc_id", "item_id", "n_words", "start", weighted_similarity(F.col("item_shingles"), F.col("window")).alias("similarity"))
    return scored.where(F.col("similarity") >= similarity)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents (all their columns) that hold no benchmark item. Rows without doc_id stay."""
    return without_ids(docs, contaminated(docs, benchmark).select("doc_id"))
