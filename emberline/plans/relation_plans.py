"""Join, registry and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import graph, registry
from emberline.plans.base import query
from emberline.session import table

c = F.col

DOMAINS = [("example.com", "news"), ("example.org", "official"), ("blog.example.com", "blog"), ("spam-farm.example.org", "social"), ("therti.example.org", "journal")]
PATTERNS = [(r"utm_source=feed", "press_release"), (r"/de/\d+\.html", "press_release")]
ENDINGS = [(".example.net", "blog")]

CLASS_SQL = r"""h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages),
d(domain, type) AS (VALUES ('example.com', 'news'), ('example.org', 'official'), ('blog.example.com', 'blog'), ('spam-farm.example.org', 'social'), ('therti.example.org', 'journal')),
b AS (SELECT h.host, arg_max(type, length(domain)) AS type, arg_max(domain, length(domain)) AS domain FROM (SELECT DISTINCT host FROM h) h JOIN d ON h.host = d.domain OR ends_with(h.host, '.' || d.domain) GROUP BY h.host),
k AS (SELECT page_id, h.host, CASE WHEN contains(lower(url), 'utm_source=feed') OR regexp_matches(lower(url), '/de/\d+\.html') THEN 'press_release' ELSE coalesce(b.type, CASE WHEN ends_with(h.host, '.example.net') OR h.host = 'example.net' THEN 'blog' ELSE 'website' END) END AS type,
  CASE WHEN contains(lower(url), 'utm_source=feed') THEN 'utm_source=feed' WHEN regexp_matches(lower(url), '/de/\d+\.html') THEN '/de/\d+\.html' WHEN b.domain IS NOT NULL THEN b.domain WHEN ends_with(h.host, '.example.net') OR h.host = 'example.net' THEN '*.example.net' END AS matched FROM h LEFT JOIN b USING (host)),
t AS (SELECT *, CASE type WHEN 'official' THEN 'high' WHEN 'journal' THEN 'high' WHEN 'news' THEN 'medium' WHEN 'website' THEN 'unverified' ELSE 'low' END AS trust, type IN ('blog', 'social') AS primary_only FROM k)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = spark.createDataFrame(DOMAINS, "domain string, type string")
    return registry.classify(table(spark, sf_dir, "pages").select("page_id", "url"), "url", domains, PATTERNS, ENDINGS)


@query(f"WITH {CLASS_SQL} SELECT page_id, host, type, matched, trust, primary_only FROM t")
def trust_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("page_id", "host", "type", "matched", "trust", "primary_only")


@query(f"WITH {CLASS_SQL}, g AS (SELECT page_id % 40 AS item, count(*) AS n_sources, count(DISTINCT CASE WHEN NOT primary_only AND type <> 'press_release' THEN host END) AS n_hosts, bool_or(NOT primary_only AND type <> 'press_release' AND trust IN ('high', 'medium')) AS trusted FROM t GROUP BY 1) SELECT item, n_sources, n_hosts > 0 AS supported, n_hosts = 1 AS single_host, n_hosts > 0 AND NOT trusted AS low_trust FROM g")
def support_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.supports(classified(spark, sf_dir).withColumn("item", c("page_id") % 40), "item")


@query(f"WITH {CLASS_SQL} SELECT coalesce(type, 'other') AS channel, count(*) AS n, count(DISTINCT host) AS hosts FROM t GROUP BY 1")
def channel_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).groupBy(F.coalesce("type", F.lit("other")).alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("host").alias("hosts"))


@query("WITH d(domain, type) AS (VALUES ('example.com', 'official'), ('example.org', 'official'), ('spam-farm.example.org', 'social'), ('therti.example.org', 'journal'), ('new.example', 'news')) SELECT type, count(*) AS n FROM d GROUP BY type")
def registry_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed domains after an edit, a deletion and an addition, counted by type."""
    edits = spark.createDataFrame([("example.com", "official"), ("blog.example.com", None), ("new.example", "news")], "domain string, type string")
    return registry.override(spark.createDataFrame(DOMAINS, "domain string, type string"), edits).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_finished FROM customer")
def counts_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("o_orderstatus") == "F").alias("f"))
    return table(spark, sf_dir, "customer").join(counts, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("f", F.lit(0)).alias("n_finished"))


@query("SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left_join_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query("WITH r AS (SELECT o_custkey, list(o_orderkey) AS ids FROM orders GROUP BY 1), e AS (SELECT o_custkey, unnest(ids) AS id FROM r) SELECT e.o_custkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM e JOIN lineitem ON l_orderkey = id GROUP BY 1")
def exploded_source_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with arrays of source ids, joined to their sources."""
    items = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    sources = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return items.select("o_custkey", F.explode("ids").alias("id")).join(sources, c("id") == c("l_orderkey")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("WITH g AS (SELECT DISTINCT p_name FROM part WHERE p_brand = 'Brand#2'), a AS (SELECT * FROM part WHERE p_name NOT IN (SELECT p_name FROM g)) SELECT p_partkey, p_name FROM a WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_name IN (SELECT p_name FROM g) AND p_size = 50)")
def anti_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without the held-out terms, and without whole groups that a held-out term touches."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    gold = part.where("p_brand = 'Brand#2'").select(c("p_name").alias("gold")).distinct()
    touched = part.where("p_size = 50").join(gold, c("p_name") == c("gold"), "left_semi").select(c("p_brand").alias("b")).distinct()
    return part.join(gold, c("p_name") == c("gold"), "left_anti").join(touched, c("p_brand") == c("b"), "left_anti").select("p_partkey", "p_name")


@query("SELECT doc_id, count(*) AS n_models FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents UNION ALL SELECT DISTINCT conv_id FROM conversations) GROUP BY doc_id HAVING count(*) = 3")
def answered_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select("doc_id").unionByName(table(spark, sf_dir, "documents").select("doc_id")).unionByName(table(spark, sf_dir, "conversations").select(c("conv_id").alias("doc_id")).distinct())
    return ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_models")).where("n_models = 3")


@query("""WITH a AS (SELECT conv_id AS run, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn FROM conversations WHERE role = 'user'), b AS (SELECT conv_id AS run, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn FROM conversations WHERE role = 'assistant'),
na AS (SELECT run, count(*) AS n FROM a GROUP BY run), nb AS (SELECT run, count(*) AS n FROM b GROUP BY run) SELECT a.run, a.turn AS asked, CASE WHEN na.n = nb.n THEN b.turn END AS answered FROM a JOIN na USING (run) LEFT JOIN nb USING (run) LEFT JOIN b ON b.run = a.run AND b.k = a.k""")
def positional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions meet answers by place, but only where there are as many of both."""
    from pyspark.sql import Window

    def side(role: str, name: str) -> DataFrame:
        by = Window.partitionBy("conv_id")
        rows = table(spark, sf_dir, "conversations").where(c("role") == role)
        return rows.select(c("conv_id").alias("run"), F.row_number().over(by.orderBy("turn")).alias("k"), F.count(F.lit(1)).over(by).alias(f"n_{name}"), c("turn").alias(name))

    return side("user", "asked").join(side("assistant", "answered"), ["run", "k"], "left").select("run", "asked", F.when(c("n_asked") == c("n_answered"), c("answered")).alias("answered"))


@query("""SELECT l.event_id, (SELECT arg_max(r.event_id, (r.ts, r.event_id)) FROM events r WHERE r.user_id = l.user_id AND r.event_type = 'click' AND r.ts <= l.ts) AS last_click FROM events l WHERE l.event_type = 'purchase'""")
def asof_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision valid at a time: the last earlier row of the key, by one window over both sides."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").where(c("event_type").isin("click", "purchase")).select("user_id", "ts", "event_id", "event_type")
    last = F.last(F.when(c("event_type") == "click", c("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", (c("event_type") != "click").cast("int"), "event_id"))
    return rows.withColumn("last_click", last).where("event_type = 'purchase'").select("event_id", "last_click")


TERMS = ["the", "and", "with", "that", "und", "der", "que", "les", "del", "por"]
MENTIONS = """s AS (SELECT doc_id AS id, generate_subscripts(x, 1) AS k, unnest(x) AS s FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?\\n]+') AS x FROM documents)),
m AS (SELECT id, k, unnest(list_filter(w, lambda x, i: list_position(w, x) = i)[1:6]) AS term FROM (SELECT id, k, list_filter(regexp_extract_all(lower(s), '[\\p{L}\\p{N}_-]+'), lambda x: x IN ('the', 'and', 'with', 'that', 'und', 'der', 'que', 'les', 'del', 'por')) AS w FROM s)),
e AS (SELECT x.term AS a, y.term AS b, count(*) AS n, count(DISTINCT x.id) AS n_sources, round(least(count(*) * 0.3::DOUBLE, 10.0), 6) AS weight FROM m x JOIN m y ON x.id = y.id AND x.k = y.k AND x.term < y.term GROUP BY ALL)"""


@query(f"WITH {MENTIONS} SELECT * FROM e")
def comention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.comention_edges(graph.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS))


@query(f"WITH {MENTIONS}, n AS (SELECT term AS label, count(*) AS weight FROM m GROUP BY term ORDER BY weight DESC, label LIMIT 6) SELECT a, b, n FROM e WHERE a IN (SELECT label FROM n) AND b IN (SELECT label FROM n) ORDER BY weight DESC, n DESC, a, b LIMIT 9")
def topk_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    nodes = found.groupBy(c("term").alias("label")).agg(F.count(F.lit(1)).alias("weight"))
    return graph.heaviest(nodes, graph.comention_edges(found), 6, 9)[1].select("a", "b", "n")


UPSERT = """o AS (SELECT 'n' || (o_custkey % 30) AS id, max(o_totalprice) AS weight, list(DISTINCT o_orderkey % 11) AS ids FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), q AS (SELECT 'n' || (o_custkey % 40) AS id, max(o_totalprice) AS weight, list(DISTINCT o_orderkey % 7) AS ids FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
u AS (SELECT id, max(weight) AS weight, list_sort(list_distinct(flatten(list(ids)))) AS ids FROM (SELECT * FROM o UNION ALL SELECT * FROM q) GROUP BY id)"""


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    def half(state: str, n: int, m: int) -> DataFrame:
        rows = table(spark, sf_dir, "orders").where(c("o_orderstatus") == state)
        return rows.groupBy(F.concat(F.lit("n"), c("o_custkey") % n).alias("id")).agg(F.max("o_totalprice").alias("weight"), F.collect_set(c("o_orderkey") % m).alias("source_ids"))

    return graph.upsert(half("F", 30, 11), half("P", 40, 7), ["id"])


@query(f"WITH {UPSERT} SELECT id, weight, array_to_string(ids, ',') AS sources FROM u")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(spark, sf_dir).select("id", "weight", F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("sources"))


@query(f"WITH {UPSERT} SELECT id, len(list_filter(ids, lambda x: x <> 3)) AS n_sources FROM u WHERE len(list_filter(ids, lambda x: x <> 3)) > 0")
def graph_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.remove_source(upserted(spark, sf_dir), F.lit(3)).select("id", F.size("source_ids").cast("long").alias("n_sources"))
