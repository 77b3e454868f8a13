"""Verdicts, tiers, exclusion of known terms, summaries and supplements."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.operators import labelling, summaries
from emberline.plans.base import query
from emberline.session import table

c = F.col
DAY = date(2024, 6, 30)

FACTS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN make_date(2013 + p_size::INT % 12, 3, 1) END AS article, p_partkey % 7 <> 0 AS asked, p_size * 130 AS vol, p_partkey % 5 <> 0 AS vol_ok,
 CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size * 20 END AS alt, p_partkey % 2 = 0 AS alt_ok, p_size % 3 AS pre, p_partkey % 11 <> 0 AS pre_ok, p_partkey % 60 AS recent, 2000 + p_size % 24 AS first_year, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 50) / 100.0 END AS slope FROM part"""
VERDICT = """CASE WHEN asked AND date_diff('day', article, DATE '2024-06-30') / 365.25 >= 7 THEN 'mature' WHEN coalesce(CASE WHEN vol_ok THEN vol END, CASE WHEN alt_ok THEN alt END) >= 5000 THEN 'mature'
 WHEN NOT (asked OR vol_ok OR alt_ok OR pre_ok) THEN 'unverified' WHEN greatest(CASE WHEN vol_ok THEN vol END, CASE WHEN alt_ok THEN alt END, CASE WHEN pre_ok THEN pre END) = 0 THEN 'unverified' ELSE 'early' END"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = c("p_partkey"), c("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 3 == 0, F.make_date((size % 12 + 2013).cast("int"), F.lit(3), F.lit(1))).alias("article"), (k % 7 != 0).alias("asked"), (size * 130).alias("vol"), (k % 5 != 0).alias("vol_ok"),
        F.when(k % 4 == 0, 0).otherwise(size * 20).alias("alt"), (k % 2 == 0).alias("alt_ok"), (size % 3).alias("pre"), (k % 11 != 0).alias("pre_ok"), (k % 60).alias("recent"), (size % 24 + 2000).alias("first_year"), F.when(k % 9 != 0, (k % 50) / 100).alias("slope"),
    )


def verdict():
    return labelling.maturity_verdict(c("article"), c("asked"), [(c("vol"), c("vol_ok")), (c("alt"), c("alt_ok"))], (c("pre"), c("pre_ok")), DAY)


@query(f"WITH f AS ({FACTS}) SELECT id, {VERDICT} AS verdict FROM f")
def maturity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("id", verdict().alias("verdict"))


@query(f"""WITH f AS ({FACTS}), v AS (SELECT *, {VERDICT} AS verdict, date_diff('day', article, DATE '2024-06-30') / 365.25 AS age FROM f),
l AS (SELECT list_sort(list(recent))[floor(0.9 * count(*))::BIGINT + 1] AS hi, list_sort(list(recent))[floor(0.75 * count(*))::BIGINT + 1] AS top FROM f)
SELECT id, CASE WHEN verdict = 'unverified' THEN NULL WHEN verdict = 'mature' THEN 'N1' WHEN age >= 7 THEN 'N1' WHEN recent < 15 THEN NULL WHEN 2024 - first_year >= 10 AND recent >= hi THEN 'N1'
 WHEN slope <= 0.08 THEN 'N3e' WHEN recent >= top AND slope >= 0.25 THEN 'N3d' END AS kind FROM v, l""")
def negative_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    judged = rows.crossJoin(F.broadcast(labelling.pool_limits(rows, "recent")))  # one row
    return judged.select("id", labelling.negative_kind(verdict(), c("article"), c("recent"), c("first_year"), c("slope"), c("high_volume"), c("top_quartile"), DAY).alias("kind"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 1 THEN 'silver' WHEN o_custkey % 5 >= 3 THEN 'silver' WHEN o_custkey % 5 > 0 OR (o_orderstatus = 'F' AND o_totalprice > 0) THEN 'bronze' ELSE 'drop' END AS tier FROM orders""")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.when(c("o_orderstatus") == "F", c("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", labelling.tier(c("o_orderkey") % 2, F.nullif(c("o_custkey") % 5, F.lit(0)), [paid]).alias("tier"))


@query(f"""WITH s AS (SELECT p_partkey, ('0x' || substr(sha256('key ' || p_partkey), 1, 8))::BIGINT AS h, {[x for x in labelling.LANGUAGES if x not in ("en", "ru")]} AS o FROM part)
SELECT p_partkey, 'en,ru,' || o[h % 12 + 1] || ',' || o[(h + 1) % 12 + 1] || ',' || o[(h + 2) % 12 + 1] || ',' || o[(h + 3) % 12 + 1] AS languages FROM s""")
def language_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(labelling.training_languages(F.concat(F.lit("key "), "p_partkey")), ",").alias("languages"))


@query("""WITH n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) || ' model' AS term FROM part), g AS (SELECT DISTINCT p_name || ' kit' AS term FROM part WHERE p_size % 25 = 0),
a AS (SELECT term, list_distinct(list_filter(string_split(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x NOT IN ('', 'model', 'data'))) AS w FROM n), b AS (SELECT list_distinct(string_split(term, ' ')) AS o FROM g)
SELECT DISTINCT term FROM a, b WHERE len(w) >= 2 AND len(o) >= 2 AND (len(list_intersect(w, o)) IN (len(w), len(o)) OR len(list_intersect(w, o)) / len(list_distinct(list_concat(w, o))) >= 0.6)""")
def excluded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return labelling.excluded_terms(part.select(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("model")).alias("term")), part.where(c("p_size") % 25 == 0).select(F.concat_ws(" ", "p_name", F.lit("kit")).alias("term")))


@query("""WITH RECURSIVE n AS (SELECT concat_ws(' ', p_name, p_type, p_brand) AS name, min(p_partkey) AS id FROM part GROUP BY 1),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS rn, list_distinct(list_filter(string_split(trim(regexp_replace(lower(name), '[^a-zа-я0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 3)) AS w FROM n),
r AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS id, false AS claimed, []::VARCHAR[][] AS held
UNION ALL SELECT rn, id, ok, CASE WHEN ok THEN list_append(held, w) ELSE held END FROM (SELECT o.rn, o.id, o.w, r.held,
len(o.w) > 0 AND len(list_filter(r.held, lambda h: len(list_intersect(h, o.w)) / len(list_distinct(list_concat(h, o.w))) > 0.6)) = 0 AS ok FROM r JOIN o ON o.rn = r.rn + 1))
SELECT id, claimed FROM r WHERE rn > 0""")
def claimed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in the order of their first part; the SQL takes them one by one, as the rule says."""
    names = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name")).agg(F.min("p_partkey").alias("id"))
    return labelling.claim_names(names.select("id", "name"))


@query("""SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 6 <> 1 AND p_size % 9 <> 0 AND make_date(2020 + p_size::INT % 8, 1, 1) <= DATE '2024-06-30' AND p_name NOT IN ('cold widget') AND NOT regexp_matches(p_name || ' ' || p_type, '(?i)promo')
 AND regexp_matches(p_type, '(?i)econ|stand') AND p_partkey % 10 <> 3 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey = 5)""")
def eligible_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k, size = c("p_partkey"), c("p_size")
    url = F.concat(F.lit("https://Code.example/"), k)
    repos = part.select(
        k, c("p_name").alias("name"), c("p_type").alias("description"), url.alias("html_url"), F.when(k % 4 != 0, "https://x.example").alias("homepage"), (k % 6 == 1).alias("fork"), (size % 9 == 0).alias("archived"),
        F.concat((size % 8 + 2020).cast("string"), F.lit("-01-01T00:00:00Z")).alias("created_at"),
    )
    used = part.where(k % 10 == 3).select(F.lower(url).alias("html_url"))
    return labelling.eligible_products(repos, used, part.where(k == 5).select(F.upper("p_name").alias("name")), ("cold widget",), "(?i)econ|stand", "(?i)promo", DAY).select("p_partkey")


@query("""WITH n AS (SELECT o_orderpriority AS topic, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT *, max(y) OVER (PARTITION BY topic) AS top FROM n)
SELECT topic, sum(n)::BIGINT AS total, sum(CASE WHEN y > top - 3 THEN n ELSE 0 END)::BIGINT AS recent_3y, round(sum(CASE WHEN y > top - 3 THEN n ELSE 0 END) / sum(n), 4) AS recent_share, string_agg(y || '=' || n, ',' ORDER BY y) FILTER (WHERE y >= top - 5) AS by_year FROM m GROUP BY topic""")
def publication_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").groupBy(c("o_orderpriority").alias("topic"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return summaries.publication_summary(years, "topic").withColumn("by_year", F.array_join(F.transform(F.map_entries("by_year"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query("""WITH w AS (SELECT l_returnflag AS topic, l_orderkey AS work, l_suppkey AS i, s_nationkey AS country, s_suppkey % 10 = 0 AS firm FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
n AS (SELECT topic, i, count(DISTINCT work) AS n FROM w GROUP BY ALL), h AS (SELECT topic, count(*) AS institutions, sum((n * n)::DOUBLE) / (sum(n)::DOUBLE * sum(n)) AS hhi FROM n GROUP BY topic), f AS (SELECT topic, work, max(firm::INT) AS firm FROM w GROUP BY ALL)
SELECT topic, institutions, (SELECT count(DISTINCT country) FROM w WHERE w.topic = h.topic) AS countries, round((SELECT avg(firm) FROM f WHERE f.topic = h.topic), 6) AS industry_share, round(hhi, 8) AS hhi FROM h""")
def institution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("institution"), c("s_nationkey").alias("country"), F.when(c("s_suppkey") % 10 == 0, "company").otherwise("education").alias("type"))
    works = table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("topic"), c("l_orderkey").alias("work"), c("l_suppkey").alias("institution")).join(supplier, "institution")
    return summaries.institution_stats(works, "topic").withColumns({"hhi": F.round("hhi", 8), "industry_share": F.round("industry_share", 6)})


@query(r"""WITH r AS (SELECT conv_id, turn, DATE '2024-01-01' + (turn * 7 + conv_id % 5)::INT AS day, array_to_string(list_slice(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1, 6), ' ') AS head FROM conversations WHERE role = 'user'),
o AS (SELECT * FROM r WHERE day <= DATE '2024-01-25' QUALIFY row_number() OVER (PARTITION BY conv_id, head ORDER BY turn) = 1)
SELECT conv_id, turn, day FROM o QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY day DESC, turn) <= 2""")
def money_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(c("role") == "user", "money").otherwise("market").alias("channel"), F.date_add(F.lit("2024-01-01").cast("date"), (c("turn") * 7 + c("conv_id") % 5).cast("int")).alias("day"), c("text").alias("title"), F.lit("u").alias("url")
    )
    return summaries.money_events(references, "conv_id", [c("turn")], date(2024, 1, 25), most=2).select("conv_id", "turn", "day")


@query("""WITH r AS (SELECT l_discount AS a, (l_discount + l_tax) / 2 AS b, l_linenumber % 3 AS sa, l_partkey % 3 AS sb, l_quantity AS s FROM lineitem), q AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM r)
SELECT round(avg(((a >= 0.05) = (b >= 0.05))::INT), 3) AS decision, round(avg((sa = sb)::INT), 3) AS stage, round(avg(abs(a - b)), 3) AS mean_abs_difference, (SELECT round(median(s), 1) FROM r) AS median_seconds, (SELECT round(max(s), 1) FROM q WHERE i = floor(0.9 * (n - 1))) AS p90_seconds FROM r""")
def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(c("l_discount").alias("p_a"), ((c("l_discount") + c("l_tax")) / 2).alias("p_b"), (c("l_linenumber") % 3).alias("stage_a"), (c("l_partkey") % 3).alias("stage_b"), c("l_quantity").alias("seconds"))
    return summaries.agreement(rows, 0.05)


@query("""WITH m AS (SELECT o_custkey AS id, o_totalprice AS price, o_orderpriority AS stage FROM orders WHERE o_orderdate::DATE <= DATE '1998-12-31' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_totalprice DESC, o_orderpriority DESC) = 1)
SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_retailprice END, price) AS price, stage FROM part LEFT JOIN m ON id = p_partkey""")
def supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue records, their gaps filled from the latest supplement of the same name."""
    records = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.when(c("p_size") % 2 == 0, c("p_retailprice")).alias("price"), F.lit(None).cast("string").alias("stage"))
    more = table(spark, sf_dir, "orders").select(c("o_custkey").alias("id"), F.to_date("o_orderdate").alias("day"), c("o_totalprice").alias("price"), c("o_orderpriority").alias("stage"))
    return summaries.supplemented(records, more, "id", ["price", "stage"], date(1998, 12, 31))


@query("SELECT r_name AS type, count(n_nationkey) AS domains FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 4 = 0 GROUP BY r_name")
def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry types with their number of domains, types without any too."""
    domains = table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").groupBy(c("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "region").join(domains, "r_regionkey", "left").select(c("r_name").alias("type"), F.coalesce("n", F.lit(0)).alias("domains"))


@query("""WITH b AS (SELECT p_type AS bucket, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_partkey, bucket, CASE WHEN bucket = 'PROMO' THEN i // 2 WHEN bucket = 'ECONOMY' THEN i ELSE 2147483647 END AS round, CASE WHEN bucket = 'PROMO' THEN CASE WHEN i % 2 = 0 THEN 0 ELSE 2 END WHEN bucket = 'ECONOMY' THEN 1 ELSE i END AS slot FROM b""")
def bucket_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets take turns, one of them twice a round."""
    placed = table(spark, sf_dir, "part").select("p_partkey", c("p_type").alias("bucket"), (F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey")) - 1).alias("i"))
    return placed.select("p_partkey", "bucket", summaries.cycle_position(c("bucket"), c("i"), ["PROMO", "ECONOMY", "PROMO"]).alias("at")).select("p_partkey", "bucket", "at.round", "at.slot")
