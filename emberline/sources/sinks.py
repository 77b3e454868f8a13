"""Sinks: upserts by key, exports to CSV, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.windows import keep_first


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of old ones of the same key; of repeated new keys nothing is decided here: make them unique first."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], when: Column) -> DataFrame:
    return keep_first(rows, keys, [when.desc()])


def delete_cascade(parents: DataFrame, children: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def recover(runs: DataFrame) -> DataFrame:
    """Runs that were under way when the service stopped are interrupted."""
    return runs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("sep", ";").option("quoteAll", True).mode("overwrite").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, group: str, title: str, line: Column, order: str) -> DataFrame:
    """group, report: a heading and one bullet for each row, in order."""
    listed = rows.groupBy(group).agg(F.first(title).alias("t"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    return listed.select(group, F.concat(F.lit("# "), F.col("t"), F.lit("\n\n"), F.array_join(F.transform("x", lambda x: F.concat(F.lit("- "), x["l"])), "\n")).alias("report"))
