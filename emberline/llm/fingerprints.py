"""Document fingerprints: one-permutation MinHash, optimally densified, packed to low-order bits.

Only built-in functions. A document's shingles are runs of five words (fewer words: all of them). Each is
hashed once; the high bits of the hash are its bin, and a bin keeps its smallest hash. An empty bin draws bins, each by
a hash of its own number and the number of the attempt, until one is filled, and borrows from that (after ATTEMPTS,
which matters to documents of one or two filled bins, from the lowest filled bin). Of each bin the low BITS bits are
stored, eight bins to a long, of the hash mixed with the bin's number: what several bins borrowed from one must not
agree by chance in all of them at once. Likeness is the share of equal bins, corrected for the share that is equal by
chance, between 0 and 1.

Equal texts have equal fingerprints. Null text counts as empty; a text without words has the fingerprint of
all zeros, at likeness 1 to another such. Rows without doc_id are left out. Repeated rows of a doc_id are one
document (of different texts under one id, the one of the greatest hash). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.columns import let
from emberline.llm.common import ASCII_SPACE, buckets_for, slim
from emberline.session import materialize

BINS = 128  # two longs hold which are filled
BITS = 8
WORDS = 5
PER_LONG, LONGS = 64 // BITS, BINS * BITS // 64
ATTEMPTS = (4, 20, 100, 612)


def long(x: int | Column) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(text, f"[{ASCII_SPACE}]+", -1), lambda w: w != "")


def shingle_hashes(words: Column, width: int = WORDS) -> Column:
    """A hash of each run of `width` words (of all words where there are fewer), repeats included."""

    def runs(own: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(width)])
        return F.when(F.size(own) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(own) - width, F.lit(0))), run))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _bins(hashes: Column) -> Column:
    bin_of = lambda x: F.shiftright(x, 56).cast("int")  # noqa: E731  of 63 bits, the top seven
    low = long((1 << BITS) - 1)

    def packed(firsts: Column) -> Column:
        """firsts: the smallest hash of each filled bin, by bin."""

        def mask(begin: int) -> Column:
            return F.aggregate(firsts, long(0), lambda m, x: F.when(bin_of(x).between(begin, begin + 63), m.bitwiseOR(F.call_function("shiftleft", long(1), bin_of(x) - begin))).otherwise(m))

        def stored(filled: Column) -> Column:
            lower, upper = filled["lower"], filled["upper"]
            has = lambda b: F.when(b < 64, F.call_function("getbit", lower, b)).otherwise(F.call_function("getbit", upper, b - 64)) == 1
            below = lambda b: F.bitwise_not(F.call_function("shiftleft", long(-1), b))
            place = lambda b: F.when(b < 64, F.bit_count(lower.bitwiseAND(below(b)))).otherwise(F.bit_count(lower) + F.bit_count(upper.bitwiseAND(below(b - 64))))

            def source(j: Column) -> Column:
                draw = lambda t: F.pmod(F.xxhash64(j, t), F.lit(BINS)).cast("int")
                first = lambda a, b: F.get(F.filter(F.transform(F.sequence(F.lit(a), F.lit(b)), draw), has), F.lit(0))
                draws = [first(a + 1, b) for a, b in zip((0, *ATTEMPTS), ATTEMPTS)]
                return F.when(has(j), j).otherwise(F.coalesce(*draws, bin_of(F.get(firsts, F.lit(0)))))

            def byte(j: Column) -> Column:
                return F.xxhash64(F.element_at(firsts, place(source(j)) + 1), j).bitwiseAND(low)

            def eight(k: Column) -> Column:
                return F.aggregate(F.sequence(F.lit(0), F.lit(PER_LONG - 1)), long(0), lambda x, i: F.call_function("shiftleft", x, F.lit(BITS)).bitwiseOR(byte(k * PER_LONG + i)))

            return F.transform(F.sequence(F.lit(0), F.lit(LONGS - 1)), eight)

        return let(F.struct(mask(0).alias("lower"), mask(64).alias("upper")), stored)

    def firsts(ordered: Column) -> Column:
        return let(F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1)))), packed)

    positive = F.transform(hashes, lambda x: x.bitwiseAND(long((1 << 63) - 1)))
    return F.when(F.size(hashes) == 0, F.array_repeat(long(0), LONGS)).otherwise(let(F.sort_array(positive), firsts))


def bins(text: Column) -> Column:
    """The fingerprint as an array of LONGS longs, PER_LONG bins each."""
    return let(shingle_hashes(words_of(text)), _bins)


def to_hex(packed: Column) -> Column:
    """BINS bins of BITS bits in lower-case hexadecimal."""
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def from_hex(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LONGS - 1)), lambda k: F.conv(F.substr(text, k * 16 + 1, F.lit(16)), 16, -10).cast("long"))


def fingerprint(text: Column) -> Column:
    return to_hex(bins(text))


def bin_likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: equal bins, less those equal by chance. A bin differs where its byte of the difference has any bit."""

    def differ(x: Column) -> Column:
        spread = lambda step: lambda y: y.bitwiseOR(F.shiftrightunsigned(y, step))
        for step in (4, 2, 1):
            x = let(x, spread(step))
        return F.bit_count(x.bitwiseAND(long(0x0101010101010101)))

    differing = F.aggregate(F.zip_with(a, b, lambda x, y: differ(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    chance = 1 / (1 << BITS)
    return F.when(differing == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (1 - differing / F.lit(BINS) - chance) / (1 - chance)))


def likeness(a: Column, b: Column) -> Column:
    """The same of two fingerprints in hexadecimal."""
    return bin_likeness(from_hex(a), from_hex(b))


def next_documents(docs: DataFrame, rows_per_part: int = 1 << 20) -> DataFrame:
    """doc_id, n_chars, next_id: the next smaller doc_id, of the smallest the largest.

    Only ids and lengths are ordered: range-partitioned, and each partition looked through by itself. The
    first and last row of each partition, and no more, are set against each other.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.struct(F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n"))).alias("chosen")).select("doc_id", F.col("chosen.n").alias("n_chars"))
    ids, _ = materialize(ids, "document-ids")
    n = buckets_for(ids.count(), rows_per_part)
    parts, _ = materialize(ids.repartitionByRange(n, "doc_id").select("doc_id", "n_chars", F.spark_partition_id().alias("part")), "ordered-ids")
    inside = parts.select("*", F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id")).alias("next_id"))
    ends = sorted(parts.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect(), key=lambda r: r["part"])  # a row a partition
    links = [(r["low"], ends[k - 1]["high"]) for k, r in enumerate(ends)]
    edges = docs.sparkSession.createDataFrame(links, "low long, high long")
    return inside.join(F.broadcast(edges), F.col("doc_id") == F.col("low"), "left").select("doc_id", "n_chars", F.coalesce("next_id", "high").alias("next_id"))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows for each doc_id.

    Texts move once, by doc_id. What a document needs of the next one's text, the code points that replace its end,
    is cut there and sent to it: a third of the texts moves again. Each fingerprint is worked out once; the next
    document's is joined to it as LONGS longs.
    """
    docs = slim(docs)
    order = next_documents(docs)
    texts = docs.groupBy("doc_id").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text")).alias("chosen")).select("doc_id", "chosen.text")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    asked = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "n_chars")
    sent = texts.join(asked, "doc_id").select(F.col("for_id").alias("doc_id"), F.col("doc_id").alias("next_id"), F.substr("text", F.lit(1), third).alias("head"))
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 3).cast("int")), "head")
    both = texts.join(sent, "doc_id").select("doc_id", "next_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    marked = both.select("doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), bins(F.col("text")).alias("own"), bins(F.col("edited")).alias("other"))
    marked, _ = materialize(marked, "fingerprints")
    out = marked.join(marked.select(F.col("doc_id").alias("next_id"), F.col("own").alias("following")), "next_id")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", to_hex(F.col("own")).alias("fingerprint"), to_hex(F.col("other")).alias("edited_fingerprint"),
        bin_likeness(F.col("own"), F.col("other")).alias("near_edited"), bin_likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
