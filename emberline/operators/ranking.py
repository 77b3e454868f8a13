"""Rankings: short lists, quotas over sources, clusters of one technology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shortlist(df: DataFrame, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows with their rank. The limit comes first, as a top-k over partitions; numbering sees n rows."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def cluster_leaders(items: DataFrame, components: DataFrame, order: list[Column], n: int) -> DataFrame:
    """One row a component: its first item by order, with the others' ids, ranked; items (id, ...), components (node, component)."""
    named = items.join(components, F.col("id") == F.col("node"), "left").withColumn("cluster", F.coalesce("component", "id")).drop("node", "component")
    ranked = named.withColumn("__rn", F.row_number().over(Window.partitionBy("cluster").orderBy(*order)))
    related = ranked.where("__rn > 1").groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("related"))
    leaders = ranked.where("__rn = 1").drop("__rn").join(related, "cluster", "left").withColumn("related", F.coalesce("related", F.array().cast("array<long>")))
    return shortlist(leaders, order, n)
