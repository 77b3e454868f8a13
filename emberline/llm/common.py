"""What the text operators share.

Every operator takes a DataFrame of documents and reads the columns doc_id and text alone, so that
further columns, whatever their names, never reach its joins; filters that return all columns join by names
that no column has (free_name). Words are runs of anything but ASCII
white space, as bytes.split() gives them.
"""

from __future__ import annotations

import math
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.session import materialize

ASCII_SPACE = r"\x20\x09-\x0D"


def small_batches(docs: DataFrame, rows: int = 1000) -> None:
    """Texts are long: unless the session says otherwise, they go to Python in batches of `rows`, not of 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if docs.sparkSession.conf.get(name) == "10000":
        docs.sparkSession.conf.set(name, str(rows))


def slim(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long) and text (null: empty), and what else is named. Rows without a doc_id can't be told apart and go."""
    small_batches(docs)
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more
    )


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one pass over the text column, one number to the driver."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def buckets_for(n_bytes: int, per_bucket: int) -> int:
    """Buckets in proportion to the input, so that each stays as large as it is today."""
    return max(12, math.ceil(n_bytes / per_bucket))


def hash_sample(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """At most n rows, those with the smallest hash of doc_id, ties by order.

    A count says which share of all hashes holds about twice as many; only that share is ordered, so what meets
    follows n and not the number of partitions. Where the share turns out to hold too few, all rows are ordered.
    """
    total = rows.count()
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    few = rows.where(h < int((1 << 31) * min(1.0, (2 * n + 100) / max(1, total))))
    if total > 2 * n + 100 and few.count() < n:
        few = rows
    return few.orderBy(h, *order).limit(n)


def crc32_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that no column of df is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, few: int = 1 << 20) -> DataFrame:
    """df, to be broadcast where it has at most `few` rows. It is counted: give it materialised."""
    return F.broadcast(df) if df.count() <= few else df


def without_ids(docs: DataFrame, gone: DataFrame, few: int = 1 << 20) -> DataFrame:
    """Documents (all their columns) whose doc_id isn't in gone. Up to `few` ids are broadcast, more go by a shuffle."""
    id_ = free_name(docs, "gone_id")
    ids, _ = materialize(gone.select(F.col("doc_id").alias(id_)).distinct(), "gone-ids")
    return docs.join(small(ids, few), docs["doc_id"] == ids[id_], "left_anti")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, and the length at the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)
