"""Order-dependent, windowed and top-k queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.operators import windows as w
from emberline.operators.ranking import shortlist
from emberline.plans.base import query
from emberline.session import table

c = F.col


@query("SELECT event_id, event_type, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts::DATE END AS published, CASE WHEN event_id % 13 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'excluded_date' ELSE 'read' END WHEN ts::DATE > DATE '2024-01-20' THEN 'excluded_date' ELSE 'read' END AS status FROM events")
def asof_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources dated after the evaluation date are excluded, undated ones where the run is historical."""
    day = F.when(c("event_id") % 13 != 0, F.to_date("ts"))
    historical = c("event_id") % 2 == 0
    status = F.when(day > F.lit("2024-01-20").cast("date"), "excluded_date").when(day.isNull() & historical, "excluded_date").otherwise("read")
    return table(spark, sf_dir, "events").select("event_id", "event_type", day.alias("published"), status.alias("status"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], [c("ts"), c("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS position FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.keep_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [c("event_id")])


@query("SELECT event_type, ts::DATE AS day, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY value DESC, event_id) <= 30")
def top_n_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return w.top_n(rows, ["event_type", "day"], [c("value").desc(), c("event_id")], 30).select("event_type", "day", "event_id")


@query("WITH t AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events) SELECT event_type, user_id, event_id, turn FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY turn, event_type) = 1")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    return w.interleave(rows, "event_type", [c("event_id")], "user_id").select("event_type", "user_id", "event_id", c("turn").cast("long"))


@query("""WITH o AS (SELECT event_id, event_type FROM events WHERE event_type <> 'purchase' ORDER BY event_id LIMIT 100), p AS (SELECT event_id, event_type FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 25) SELECT * FROM o UNION ALL SELECT * FROM p""")
def reserve_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.reserve_channel(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", "purchase", 100, 0.25)


@query("SELECT conv_id, turn, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 4)::BIGINT AS batch FROM conversations")
def batch_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.batch_number(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], [c("turn")], 4)


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def version_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.version_number(table(spark, sf_dir, "events"), ["user_id"], [c("ts"), c("event_id")]).select("event_id", "user_id", c("version").cast("long"))


@query("WITH l AS (SELECT conv_id, role, turn, sha256(text) AS h FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1) SELECT conv_id, max(CASE WHEN role = 'user' THEN h END) AS \"user\", max(CASE WHEN role = 'assistant' THEN h END) AS assistant FROM l GROUP BY conv_id")
def latest_reaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word of each side of a conversation, side by side."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max_by(F.sha2("text", 256), "turn").alias("h"))
    return last.groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.first("h"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) <= 5")
def hash_shuffle_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed shuffle by the hash of the id, and a quota for each stratum."""
    return w.top_n(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], [F.sha2(c("doc_id").cast("string"), 256), c("doc_id")], 5)


@query("WITH g AS (SELECT p_partkey, p_type, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_name ORDER BY sha256(p_partkey::VARCHAR), p_partkey) = 1) SELECT p_type, p_name, p_partkey FROM g QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY sha256(p_partkey::VARCHAR), p_partkey) <= 7")
def quota_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.sha2(c("p_partkey").cast("string"), 256), c("p_partkey")]
    return w.quota(table(spark, sf_dir, "part").select("p_type", "p_name", "p_partkey"), "p_type", "p_name", order, 7)


@query("WITH s AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS not_weak, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS fallback FROM orders ORDER BY not_weak, fallback, o_totalprice DESC, o_custkey DESC, o_orderkey LIMIT 15) SELECT *, row_number() OVER (ORDER BY not_weak, fallback, o_totalprice DESC, o_custkey DESC, o_orderkey) AS rank FROM s")
def shortlist_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (c("o_orderstatus") != "F").cast("int").alias("not_weak"), (c("o_orderkey") % 5 == 0).cast("int").alias("fallback"))
    return shortlist(rows, [c("not_weak"), c("fallback"), c("o_totalprice").desc(), c("o_custkey").desc(), c("o_orderkey")], 15)


@query("WITH o AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS trust, ts FROM events) SELECT user_id, event_id FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY trust DESC, ts DESC, event_id) <= 3")
def sources_by_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = F.when(c("event_type") == "purchase", 3).when(c("event_type") == "signup", 2).when(c("event_type") == "click", 1).otherwise(0)
    return w.top_n(table(spark, sf_dir, "events").withColumn("trust", trust), ["user_id"], [c("trust").desc(), c("ts").desc(), c("event_id")], 3).select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders) WHERE running <= 900000")
def budgeted_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest items of each owner that fit a budget."""
    return w.pack_by_budget(table(spark, sf_dir, "orders"), ["o_custkey"], [c("o_orderdate").desc(), c("o_orderkey")], c("o_totalprice"), 900000).select("o_custkey", "o_orderkey")


@query("WITH m AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, y, n, round(ln(1 + n) - ln(1 + lag(n) OVER (PARTITION BY o_custkey ORDER BY y)), 6) AS growth FROM m")
def period_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.partitionBy("o_custkey").orderBy("y"))
    return m.select("o_custkey", "y", "n", F.round(F.log1p(c("n").cast("double")) - F.log1p(before.cast("double")), 6).alias("growth"))


@query("""WITH s AS (SELECT y FROM range(1994, 2003) AS t(y)), n AS (SELECT o_orderpriority AS channel, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL), ch AS (SELECT channel, min(y) AS first FROM n GROUP BY channel)
SELECT channel, s.y::INT AS y, CASE WHEN s.y > 2001 THEN NULL WHEN channel = '5-LOW' AND s.y < 1997 THEN NULL ELSE coalesce(n, 0) END AS n FROM ch CROSS JOIN s LEFT JOIN n USING (channel, y)""")
def evidence_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel by year: a year without rows is 0 where the channel was covered, and unknown where it wasn't."""
    n = table(spark, sf_dir, "orders").groupBy(c("o_orderpriority").alias("channel"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    spine = n.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(1994), F.lit(2002))).alias("y"))
    covered = (c("y") <= 2001) & ~((c("channel") == "5-LOW") & (c("y") < 1997))
    return spine.join(n, ["channel", "y"], "left").select("channel", "y", F.when(covered, F.coalesce("n", F.lit(0))).alias("n"))


@query("""WITH i AS (SELECT o_custkey % 60 AS k, o_orderdate::DATE AS a, o_orderdate::DATE + 40 AS b FROM orders), g AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
s AS (SELECT *, sum((before IS NULL OR a > before + 1)::INT) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM g), u AS (SELECT k, island, min(a) AS a, max(b) AS b FROM s GROUP BY k, island)
SELECT k, year(y)::BIGINT AS y FROM u, unnest(generate_series(DATE '1994-01-01', DATE '2002-01-01', INTERVAL 1 YEAR)) AS t(y) WHERE a <= y AND b >= y + INTERVAL 1 YEAR - INTERVAL 1 DAY""")
def covered_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that the union of an item's intervals covers whole: gaps and islands, then a year spine."""
    i = table(spark, sf_dir, "orders").select((c("o_custkey") % 60).alias("k"), F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 40).alias("b"))
    by = Window.partitionBy("k").orderBy("a", "b")
    g = i.withColumn("before", F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    new = (c("before").isNull() | (c("a") > F.date_add("before", 1))).cast("int")
    u = g.withColumn("island", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    years = u.select("k", "a", "b", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y"))
    return years.where((c("a") <= F.make_date("y", F.lit(1), F.lit(1))) & (c("b") >= F.make_date("y", F.lit(12), F.lit(31)))).select("k", c("y").cast("long").alias("y"))
