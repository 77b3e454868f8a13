"""Weighted knowledge graphs: co-mention edges, upserts, removal of a contribution, the heaviest part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_id(label: Column) -> Column:
    return F.concat(F.lit("node_"), F.substr(F.sha1(F.lower(F.trim(label))), F.lit(1), F.lit(12)))


def mentions(docs: DataFrame, id_: str, text: str, terms: list[str], most: int = 6) -> DataFrame:
    """id, sentence, term: the first `most` terms of each sentence, in the order in which they appear."""
    sentences = docs.select(F.col(id_).alias("id"), F.posexplode(F.split(F.col(text), r"[.!?\n]+", -1)).alias("sentence", "s"))
    listed = F.array(*map(F.lit, terms))
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("s"), F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1)), lambda w: F.array_contains(listed, w)))
    return sentences.select("id", "sentence", F.explode(F.slice(words, 1, most)).alias("term"))


def comention_edges(found: DataFrame, weight: float = 0.3) -> DataFrame:
    """a, b, n, weight, source_ids: pairs of terms of a sentence; a sentence has at most 15 of them."""
    pairs = found.alias("x").join(found.alias("y"), ["id", "sentence"]).where("x.term < y.term")
    edges = pairs.groupBy(F.col("x.term").alias("a"), F.col("y.term").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_sources"))
    return edges.withColumn("weight", F.round(F.least(F.lit(1.0) * F.col("n") * weight, F.lit(10.0)), 6))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, weight, source_ids): the greater weight, the union of sources."""
    both = old.select(*keys, "weight", "source_ids").unionByName(new.select(*keys, "weight", "source_ids"))
    heavy = both.groupBy(*keys).agg(F.max("weight").alias("weight"))
    sources = both.select(*keys, F.explode_outer("source_ids").alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_set("s")).alias("source_ids"))
    return heavy.join(sources, keys)


def remove_source(graph: DataFrame, source: Column) -> DataFrame:
    """Take a source out of every row; rows that had no other go."""
    left = F.filter("source_ids", lambda s: s != source)
    return graph.withColumn("source_ids", left).where(F.size("source_ids") > 0)


def heaviest(nodes: DataFrame, edges: DataFrame, n_nodes: int = 180, n_edges: int = 360) -> tuple[DataFrame, DataFrame]:
    """The heaviest nodes, and the heaviest edges that have both ends among them."""
    top = nodes.orderBy(F.col("weight").desc(), "label").limit(n_nodes)
    ends = F.broadcast(top.select(F.col("label").alias("end")))  # n_nodes rows
    kept = edges.join(ends, F.col("a") == F.col("end"), "left_semi").join(ends, F.col("b") == F.col("end"), "left_semi")
    return top, kept.orderBy(F.col("weight").desc(), F.col("n").desc(), "a", "b").limit(n_edges)
