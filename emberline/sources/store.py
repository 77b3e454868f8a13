"""A store of responses that only grows by what is new, and feeds paged back to a date.

Plain Parquet has neither keys nor merges, so the store is folders of rows and a manifest that names those that count. A write
finds what is new by an anti-join on digests, writes it to a folder named after its content and then adds one manifest
entry. A run that dies between the two leaves a folder that nobody reads and that the same run, repeated, writes
again; a run without news writes nothing.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import materialize, release

ENTRY = "digest string, source string, request string, body string, fetched_at timestamp"


def digest(source: str, request: str):
    """The key of a response: of its source and its request."""
    return F.sha2(F.concat_ws("|", F.col(source), F.col(request)), 256)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders that the manifest names, one for each write that found news."""
    where, fs = _files(spark, f"{path}/manifest")
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All committed entries: digest, source, request, body, fetched_at."""
    names = committed(spark, path)
    if not names:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(*(f"{path}/rows/{n}" for n in names))


def fresh(spark: SparkSession, path: str, now: datetime, max_age: timedelta | None = None) -> DataFrame:
    """The latest entry of each digest; with max_age only those not older."""
    rows = entries(spark, path).where(F.col("fetched_at") <= F.lit(now))
    if max_age is not None:
        rows = rows.where(F.col("fetched_at") >= F.lit(now - max_age))
    best = rows.groupBy("digest").agg(F.max_by(F.struct("source", "request", "body", "fetched_at"), F.struct("fetched_at", "body")).alias("r"))
    return best.select("digest", "r.*")


def wanted(requests: DataFrame, path: str, now: datetime, max_age: timedelta | None = None) -> DataFrame:
    """Requests (source, request) without an answer that is young enough: what is left to fetch."""
    keyed = requests.select("source", "request").distinct().withColumn("digest", digest("source", "request"))
    return keyed.join(fresh(requests.sparkSession, path, now, max_age).select("digest"), "digest", "left_anti")


def remember(responses: DataFrame, path: str, now: datetime, max_age: timedelta | None = None) -> int:
    """Store the successful responses (source, request, status, body) that the store lacks or has too old. How many there were.

    Success is a status of 2xx with a body. Of repeated requests the smallest body counts. The folder's name follows from
    its rows, so a repeated write of the same rows writes the same folder and the same manifest entry.
    """
    spark = responses.sparkSession
    good = responses.where((F.col("status").between(200, 299)) & F.col("body").isNotNull() & F.col("request").isNotNull())
    once = good.groupBy("source", "request").agg(F.min("body").alias("body")).withColumn("digest", digest("source", "request"))
    news = once.join(fresh(spark, path, now, max_age).select("digest"), "digest", "left_anti")
    news, held = materialize(news.select("digest", "source", "request", "body", F.lit(now).cast("timestamp").alias("fetched_at")), "news")
    mark = news.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("digest", "body", "fetched_at").cast("decimal(38,0)")).alias("h")).first()
    if mark["n"]:
        name = f"{now:%Y%m%dT%H%M%S}-{mark['n']}-{int(mark['h']) % (1 << 64):016x}"
        news.write.mode("overwrite").parquet(f"{path}/rows/{name}")
        where, fs = _files(spark, f"{path}/manifest/{name}")
        fs.mkdirs(where.getParent())
        fs.create(where, True).close()
    release(spark, held)
    return mark["n"]


def paged_back(items: DataFrame, cutoff, most: int = 120) -> DataFrame:
    """The items (feed, page from 1, position, url, published) that paging back to a date takes in, all their columns.

    Pages are taken in order up to the first that isn't there or has no address that earlier pages lack, which is left out,
    or that has an item from before the cutoff, which is the last; of a page that is taken the addresses seen before are left
    out. Then dated items from before the cutoff go. A feed has at most `most` pages.
    """
    old = F.lit(cutoff)
    numbered = items.where((F.col("page") >= 1) & (F.col("page") <= most))
    first = numbered.where(F.coalesce("url", F.lit("")) != "").groupBy("feed", "url").agg(F.min("page").alias("first_page"))
    pages = numbered.groupBy("feed", "page").agg(F.min("published").alias("oldest"))
    gains = first.groupBy("feed", F.col("first_page").alias("page")).agg(F.count(F.lit(1)).alias("gain"))
    told = pages.join(gains, ["feed", "page"], "left").groupBy("feed").agg(
        F.array_sort(F.collect_list(F.struct("page", (F.coalesce("gain", F.lit(0)) > 0).alias("gains"), F.coalesce(F.col("oldest") < old, F.lit(False)).alias("past")))).alias("p")
    )  # `most` entries at most
    # page k stands at place k as long as none is missing
    stop = F.filter(F.transform("p", lambda x, i: F.when((x["page"] != i + 1) | ~x["gains"], i).when(x["past"], i + 1)), lambda x: x.isNotNull())
    last = told.select("feed", F.coalesce(F.array_min(stop), F.size("p")).alias("stop_page"))
    taken = numbered.join(last, "feed").where(F.col("page") <= F.col("stop_page")).join(first, ["feed", "url"])
    kept = taken.where((F.col("page") == F.col("first_page")) & (F.col("published").isNull() | (F.col("published") >= old)))
    return kept.select(*items.columns)
