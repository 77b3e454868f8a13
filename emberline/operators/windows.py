"""Order-dependent operators: keep first or last by key, top n, interleaving, quotas, numbering.

Each takes an explicit order; ties in it must be broken by the caller's columns. Null keys form one group. All
windows are partitioned by a key, so no operator gathers a whole table in one task, but for those that say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _ranked(df, keys, order).where("__rn = 1").drop("__rn")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, in the place of the first: column position."""
    by = Window.partitionBy(*keys)
    placed = df.withColumn("position", F.min(order[0]).over(by))
    return keep_first(placed, keys, [c.desc() for c in order])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return _ranked(df, keys, order).where(F.col("__rn") <= n).drop("__rn")


def quota(df: DataFrame, stratum: str, group: str, order: list[Column], n: int) -> DataFrame:
    """At most n rows of each stratum, one of each group."""
    return top_n(keep_first(df, [stratum, group], order), [stratum], order, n)


def interleave(df: DataFrame, source: str, order: list[Column], key: str) -> DataFrame:
    """Sources take turns; a key that came up before is left out. Adds turn (place within the source)."""
    turned = df.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(*order)))
    return keep_first(turned, [key], [F.col("turn"), F.col(source)])


def reserve_channel(df: DataFrame, order: str, channel: str, wanted: str, budget: int, share: float) -> DataFrame:
    """budget rows of other channels, and beyond them budget * share (and what others leave) of the wanted one."""
    own = F.coalesce(F.col(channel) == wanted, F.lit(False))
    others = df.where(~own).orderBy(order).limit(budget)
    extra = F.lit(int(budget * share)) + F.greatest(F.lit(0), F.lit(budget) - F.col("n_others"))
    room = others.agg(F.count(F.lit(1)).alias("n_others"))
    reserved = df.where(own).orderBy(order).limit(budget + int(budget * share))
    ranked = reserved.withColumn("__rn", F.row_number().over(Window.partitionBy(channel).orderBy(order))).crossJoin(F.broadcast(room))
    return others.unionByName(ranked.where(F.col("__rn") <= extra).drop("__rn", "n_others"))


def batch_number(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))


def version_number(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def pack_by_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The leading rows of each key whose sizes sum to at most budget."""
    running = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", running).where(F.col("running") <= budget)
