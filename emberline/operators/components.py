"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import materialize, release


def _signature(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """node, component (the smallest node reachable) for every node that an edge with two ends names.

    Nodes are longs. Edges with a null end and loops are left out; repeated edges change nothing. Each
    round's edges are written to the shared folder, so that lineage stays short and a lost executor costs
    one round; only a count and a checksum come to the driver. The number of rounds grows as the logarithm
    of the longest path.
    """
    spark = edges.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now, path = materialize(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(),
        "edges",
    )
    before = _signature(now)
    for _ in range(max_rounds):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        lowest = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(lowest, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        now, path = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(spark, old)
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
