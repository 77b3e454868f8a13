"""Queries of works rolled up over request windows and of channel-years: orders as works, line items as linked sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import rollup
from emberline.plans.base import query
from emberline.plans.feature_plans import N_TECH, SNAPSHOT
from emberline.session import table

SPANS = rollup.windows(SNAPSHOT)
OK = "(tech_id + 2 * w + 3 * (provider = 'openalex')::INT) % 5 > 1"

# The same works in both engines' SQL but for the names of types.
WORKS = f"""SELECT o_custkey % {N_TECH} AS tech_id, CASE WHEN o_orderkey % 2 = 0 THEN 'crossref' ELSE 'openalex' END AS provider, o_orderkey AS position,
  CASE WHEN o_orderkey % 19 = 0 THEN (w0 + 1) % 4 ELSE w0 END AS w,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('https://doi.org/10.1/X', o_orderkey % 1103) ELSE concat('10.1/x', o_orderkey % 1103) END AS doi,
  CASE WHEN o_orderkey % 13 = 0 THEN '?!' ELSE concat('Study no. ', o_orderkey % 701) END AS title,
  CASE WHEN o_orderkey % 97 = 0 THEN 'n.d.' WHEN o_orderkey % 89 = 0 THEN '' ELSE CAST(d AS STRING) END AS published,
  concat(c_mktsegment, c_nationkey) AS institution, c_nationkey AS country, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 4) / 4.0 END AS industry_share
FROM (SELECT *, CASE WHEN d >= DATE '{SPANS[0][0]}' THEN 0 WHEN d >= DATE '{SPANS[1][0]}' THEN 1 WHEN d >= DATE '{SPANS[2][0]}' THEN 2 ELSE 3 END AS w0
  FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) o1) o JOIN customer ON o_custkey = c_custkey WHERE d <= DATE '{SNAPSHOT}'"""


def answers(spark: SparkSession) -> DataFrame:
    asked = spark.range(N_TECH).select(F.col("id").alias("tech_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("window")).select("*", F.explode(F.array(*map(F.lit, rollup.PROVIDERS))).alias("provider"))
    return asked.withColumn("ok", (F.col("tech_id") + 2 * F.col("window") + 3 * (F.col("provider") == "openalex").cast("int")) % 5 > 1)


def returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works of requests that succeeded; nobody is asked twice for the time before the windows."""
    rows = spark.sql(WORKS.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}"), orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
    rows = rows.withColumnRenamed("w", "window")
    rows = rows.withColumns({"institutions": F.array("institution"), "countries": F.array(F.col("country").cast("string")), "industry_share": F.col("industry_share").cast("double")})
    return rows.where("window < 3 OR provider = 'crossref'").join(answers(spark).where("ok").drop("ok"), ["tech_id", "window", "provider"], "left_semi")


RETURNED = f"""WITH all_works AS ({WORKS.replace('STRING', 'VARCHAR')}),
asked AS (SELECT t.tech_id, w.w, p.provider, {OK} AS ok FROM (SELECT unnest(range({N_TECH})) AS tech_id) t, (SELECT unnest(range(4)) AS w) w, (SELECT unnest(['crossref', 'openalex']) AS provider) p),
got AS (SELECT DISTINCT tech_id, w FROM asked WHERE ok AND (w < 3 OR provider = 'crossref')),
works AS (SELECT a.*, CASE WHEN coalesce(doi, '') <> '' THEN 'doi:' || lower(replace(doi, 'https://doi.org/', '')) ELSE 'title:' || trim(regexp_replace(lower(title), '[^a-z0-9_]+', ' ', 'g')) END AS key
  FROM all_works a JOIN asked USING (tech_id, w, provider) WHERE ok AND (w < 3 OR provider = 'crossref')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tech_id, w, key ORDER BY provider, position) AS rn FROM works WHERE w = 3 OR title <> '?!'),
first_of AS (SELECT * FROM ranked WHERE w = 3 OR rn = 1)"""

_B3 = rollup.years_before(SNAPSHOT, 3)


@query(f"""{RETURNED}, techs AS (SELECT unnest(range({N_TECH})) AS tech_id),
firsts AS (SELECT tech_id, min(nullif(published, '')) AS least FROM first_of f WHERE w = (SELECT max(w) FROM first_of g WHERE g.tech_id = f.tech_id) GROUP BY tech_id),
lately AS (SELECT * FROM first_of WHERE w <= 1 AND published >= '{_B3}')
SELECT t.tech_id,
  (SELECT count(*) FROM first_of f WHERE f.tech_id = t.tech_id AND w = 0) AS window_0, (SELECT count(*) FROM first_of f WHERE f.tech_id = t.tech_id AND w = 1) AS window_1,
  (SELECT count(*) FROM first_of f WHERE f.tech_id = t.tech_id AND w = 2) AS window_2,
  (SELECT count(*) FROM first_of f WHERE f.tech_id = t.tech_id AND (w = 0 OR (w = 1 AND published >= '{_B3}'))) AS count_3y,
  (SELECT count(DISTINCT key) FROM first_of f WHERE f.tech_id = t.tech_id AND key <> 'title:') AS total,
  (SELECT least FROM firsts f WHERE f.tech_id = t.tech_id) AS first_date,
  (SELECT count(*) >= 1000 FROM first_of f WHERE f.tech_id = t.tech_id AND w = 0) OR (SELECT count(*) >= 1000 FROM first_of f WHERE f.tech_id = t.tech_id AND w = 1) OR (SELECT count(*) >= 1000 FROM first_of f WHERE f.tech_id = t.tech_id AND w = 2) AS recent_results_capped,
  (SELECT count(*) >= 1000 FROM works f WHERE f.tech_id = t.tech_id AND w = 3) AS older_results_capped,
  (SELECT count(*) = 4 FROM got g WHERE g.tech_id = t.tech_id) AS history_complete,
  (SELECT count(*) = 2 FROM got g WHERE g.tech_id = t.tech_id AND w < 2) AS recent_3y_complete,
  (SELECT count(DISTINCT institution) FROM lately l WHERE l.tech_id = t.tech_id) AS institutions_3y, (SELECT count(DISTINCT country) FROM lately l WHERE l.tech_id = t.tech_id) AS countries_3y,
  (SELECT round(avg(industry_share::DOUBLE), 6) FROM lately l WHERE l.tech_id = t.tech_id) AS industry_affiliation_share_3y,
  (SELECT count(*) > 0 FROM got g WHERE g.tech_id = t.tech_id) AS ok
FROM techs t""")
def science_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by DOI or else title over four request windows of two providers, some of which failed."""
    return rollup.science_rollup(returned(spark, sf_dir), answers(spark), SNAPSHOT)


@query(f"""{RETURNED},
dated AS (SELECT tech_id, key, w, position, try_strptime(published, '%Y-%m-%d')::DATE AS day FROM first_of),
one AS (SELECT tech_id, year(day) AS y FROM dated WHERE day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tech_id, key ORDER BY (w + 1) % 4, position) = 1),
counted AS (SELECT tech_id, y, count(*) AS n FROM one GROUP BY ALL),
spine AS (SELECT tech_id, unnest(range(least({SNAPSHOT.year - 5}, coalesce((SELECT min(y) FROM counted c WHERE c.tech_id = t.tech_id), 9999)), {SNAPSHOT.year + 1})) AS year FROM (SELECT unnest(range({N_TECH})) AS tech_id) t),
days AS (SELECT tech_id, year, unnest(generate_series(make_date(year, 1, 1), least(make_date(year, 12, 31), DATE '{SNAPSHOT}'), INTERVAL 1 DAY))::DATE AS day FROM spine),
unknown AS (SELECT DISTINCT tech_id, year FROM days WHERE (tech_id, CASE WHEN day >= DATE '{SPANS[0][0]}' THEN 0 WHEN day >= DATE '{SPANS[1][0]}' THEN 1 WHEN day >= DATE '{SPANS[2][0]}' THEN 2 ELSE 3 END) NOT IN (SELECT (tech_id, w) FROM got))
SELECT s.tech_id, s.year::INTEGER AS year, CASE WHEN u.year IS NULL THEN coalesce(n, 0) END AS n
FROM spine s LEFT JOIN unknown u ON u.tech_id = s.tech_id AND u.year = s.year LEFT JOIN counted c ON c.tech_id = s.tech_id AND c.y = s.year""")
def science_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct works by year, NULL where a failed request leaves days of the year unknown; SQL looks at each day."""
    return rollup.science_years(returned(spark, sf_dir), answers(spark), SNAPSHOT)


FILL_AS_OF = SNAPSHOT
CANDIDATES = 40

MEASURED = f"""SELECT o_custkey % {CANDIDATES} AS candidate_id, ch AS channel, y AS year,
  CASE WHEN (o_custkey % {CANDIDATES} + y + length(ch)) % 3 = 0 THEN NULL ELSE count(*) % 7 END AS n
FROM (SELECT o_custkey, year(CAST(o_orderdate AS DATE)) AS y, CASE o_orderkey % 4 WHEN 0 THEN 'patents' WHEN 1 THEN 'news' WHEN 2 THEN 'funding' ELSE 'science' END AS ch FROM orders) o1
WHERE (o_custkey % {CANDIDATES}) % 8 <> 0 OR ch <> 'patents' GROUP BY o_custkey % {CANDIDATES}, ch, y"""

LINKED = f"""SELECT l_partkey % {CANDIDATES} AS candidate_id, concat('s', l_orderkey) AS source_id,
  CASE WHEN l_orderkey % 5 = 0 THEN 'failed' ELSE 'read' END AS status, CASE WHEN l_orderkey % 7 = 0 THEN 's1' END AS duplicate_of,
  CASE l_orderkey % 6 WHEN 0 THEN 'Patent' WHEN 1 THEN 'news_agency' WHEN 2 THEN 'preprint' WHEN 3 THEN 'tech_community' ELSE 'web' END AS type,
  CASE WHEN l_orderkey % 11 = 0 THEN 'money' WHEN l_orderkey % 11 = 1 THEN 'adoption' WHEN l_orderkey % 11 = 2 THEN 'market' END AS channel,
  CASE WHEN l_orderkey % 13 = 0 THEN 'github_search' WHEN l_orderkey % 13 = 1 THEN 'google_patents' END AS provider, CASE WHEN l_orderkey % 17 = 0 THEN 'Patents_x' END AS connector,
  CASE WHEN l_orderkey % 19 = 0 THEN 'grant' WHEN l_orderkey % 19 = 1 THEN 'pilot' END AS event_type,
  CASE WHEN l_orderkey % 23 = 0 THEN 'undated' WHEN l_orderkey % 23 <> 1 THEN CAST(DATE '1985-01-01' + CAST(l_orderkey % 7000 AS INT) AS STRING) END AS published_at,
  CASE WHEN l_orderkey % 2 = 0 THEN '1991-02-03T04:05:06' END AS event_date
FROM lineitem"""


@query(f"""WITH measured AS ({MEASURED}), linked AS ({LINKED.replace('STRING', 'VARCHAR')}),
own AS (SELECT DISTINCT * FROM linked WHERE status = 'read' AND duplicate_of IS NULL AND candidate_id IN (SELECT candidate_id FROM measured WHERE channel = 'patents')),
dated AS (SELECT candidate_id, try_strptime(left(coalesce(published_at, event_date), 10), '%Y-%m-%d')::DATE AS day,
  CASE WHEN lower(type) = 'patent' OR provider LIKE '%patent%' OR lower(connector) LIKE '%patent%' THEN 'patents' WHEN event_type = 'grant' OR channel = 'money' THEN 'funding'
    WHEN provider LIKE 'github%' OR type = 'tech_community' THEN 'community' WHEN event_type = 'pilot' OR channel = 'adoption' THEN 'adoption'
    WHEN channel = 'market' OR type = 'news_agency' THEN 'news' WHEN type = 'preprint' THEN 'science' ELSE 'other' END AS ch FROM own),
added AS (SELECT candidate_id, ch, year(day) AS y, count(*) AS added FROM dated WHERE day <= DATE '{FILL_AS_OF}' AND NOT (ch = 'news' AND day >= DATE '{FILL_AS_OF}' - 1461) GROUP BY ALL),
spans AS (SELECT candidate_id, min(y) AS a, max(y) AS b FROM (SELECT candidate_id, year AS y FROM measured UNION ALL SELECT candidate_id, y FROM added) GROUP BY 1),
spine AS (SELECT m.candidate_id, m.channel, unnest(range(a, b + 1)) AS year FROM (SELECT DISTINCT candidate_id, channel FROM measured) m JOIN spans s ON s.candidate_id = m.candidate_id)
SELECT s.candidate_id, s.channel, s.year::INTEGER AS year, coalesce(m.n, x.added) AS n, s.channel = 'patents' AND s.candidate_id IN (SELECT candidate_id FROM added WHERE ch = 'patents') AS capped,
  CASE WHEN s.channel = 'patents' AND s.candidate_id IN (SELECT candidate_id FROM own) THEN (SELECT count(*) FROM dated d WHERE d.candidate_id = s.candidate_id AND ch = 'patents' AND day IS NULL) END AS undated_patents
FROM spine s LEFT JOIN measured m ON m.candidate_id = s.candidate_id AND m.channel = s.channel AND m.year = s.year
LEFT JOIN added x ON x.candidate_id = s.candidate_id AND x.ch = s.channel AND x.y = s.year""")
def channel_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured channel-years of candidates, unknown ones filled from line items as linked sources."""
    measured = spark.sql(MEASURED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    linked = spark.sql(LINKED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return rollup.fill_channel_years(measured, linked, FILL_AS_OF)
