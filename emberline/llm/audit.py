"""Filter interaction audit: what five filters remove in each of their 120 orders, from one histogram of failure masks.

Failure conditions, on whole texts (null: empty) and words `[^\\x20\\x09-\\x0D]+`: A: under 100 words. B: under 80 % of the
words are distinct. C: over 10 % of the code points are A-Z. D: holds one of #$%&*|. E: a smaller doc_id has the same text.

1. Native expressions give each document the bits of A to D and a 256-bit digest of its text; texts go no further.
2. Documents are grouped by digest for the smallest doc_id, partially before the shuffle, so a text that a third of all
   documents hold is one row a task. A document passes E if its (digest, doc_id) is that smallest one: documents and
   smallest ones are joined by both, and no key is hot. All others fail E.
3. Documents are counted by part and mask: 32 cells a part, with their good and toxic documents.
4. Every order and step is a sum over the cells of its part.

A part is a lang; null lang is the empty string. Every row is a document: repeated rows of a doc_id count each and don't make
each other fail E (none has the smaller doc_id). A row without doc_id can't be placed before or after others: it passes E
and carries no label. Of several label rows of one doc_id any with quality 1 makes it good and any with toxic 1 toxic. An
empty table gives no rows. Only doc_id, text and lang, quality and toxic are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import materialize

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
CELL = ["mask", "n", "good", "toxic"]


def failures(text: Column, min_words: int = 100, min_distinct: int = 80, max_capitals: int = 10) -> Column:
    """Bits 1, 2, 4 and 8 for A to D; all but min_words are percentages. text must not be null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    bits = [
        n < min_words,
        100 * F.size(F.array_distinct(words)) < min_distinct * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > max_capitals * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((b.cast("int") * (1 << k) for k, b in enumerate(bits)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, digest, part, mask (A to D), good, toxic of each row of documents."""
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("digest"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), failures(text).alias("mask")
    )
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    return own.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (five bits), n, good, toxic: at most 32 rows a part."""
    rows, _ = materialize(masked(docs, labels), "masks")
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    sums = lambda df: df.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    passing = sums(rows.join(least, ["digest", "doc_id"]).unionByName(rows.where("doc_id is null"), allowMissingColumns=True))
    everyone = sums(rows)
    both = everyone.join(passing.select("part", "mask", *(F.col(c).alias(f"p_{c}") for c in CELL[1:])), ["part", "mask"], "left").fillna(0)
    split = F.explode(
        F.array(
            F.struct(F.col("mask"), *(F.col(f"p_{c}").alias(c) for c in CELL[1:])),
            F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - F.col(f"p_{c}")).alias(c) for c in CELL[1:])),
        )
    )
    return both.select("part", split.alias("cell")).select("part", "cell.*")


def orders_from_cells(found: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step."""
    steps = [(("".join(p)), k + 1, 1 << FILTERS.index(p[k]), sum(1 << FILTERS.index(c) for c in p[:k])) for p in permutations(FILTERS) for k in range(len(FILTERS))]
    table = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for o, k, bit, before in steps))
    parts = found.groupBy("part").agg(F.collect_list(F.struct(*CELL)).alias("cells"))  # 32 at most
    rows = parts.select("part", "cells", F.explode(table).alias("s")).select("part", "cells", "s.*")

    def total(where, of: str = "n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(where(c["mask"]), c[of]).otherwise(0))

    has = lambda m, bits: m.bitwiseAND(bits) != 0
    bit, before = F.col("bit"), F.col("before")
    here = lambda m: has(m, bit) & ~has(m, before)
    rows = rows.select(
        "part", "filter_order", "step", "bit",
        total(lambda m: ~has(m, before.bitwiseOR(bit))).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: has(m, bit) & has(m, before)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders_from_cells(cells(docs, labels))


#: The same rows in DuckDB's SQL, from documents in each order and not from cells.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
         regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c1.x, d1.x, e.x] AS seq FROM c a, c b, c c1, c d1, c e WHERE len(list_distinct([a.x, b.x, c1.x, d1.x, e.x])) = 5),
s AS (SELECT seq, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (SELECT g.*, array_to_string(seq, '') AS filter_order, step, ascii(seq[step]) - 64 AS own,
        fails[ascii(seq[step]) - 64] AS failing,
        len(list_filter(seq[1:step - 1], lambda x: fails[ascii(x) - 64])) > 0 AS gone,
        len(list_filter(fails, lambda x: x)) AS n_fails
      FROM g, s),
t AS (SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed,
        coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failing AND n_fails = 1), 0) AS unique_fails,
        coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS toxic_lost
      FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM t
"""
