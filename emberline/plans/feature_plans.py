"""Feature queries. The driver tables stand in for evidence: orders are works and news, line items patents and events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions.stats import burstiness, growth, log6, sigmoid
from emberline.operators import features, scoring
from emberline.plans.base import query
from emberline.session import table

SNAPSHOT = date(2001, 6, 30)
N_TECH = 25
KINDS = ("pilot", "deployment", "product", "funding", "grant", "regulation", "procurement")
ROUNDS = ("pre-seed", "seed", "A", "b", "C", "d+", "x")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        (c("o_custkey") % N_TECH).alias("tech_id"), F.to_date("o_orderdate").alias("published"), ((c("o_orderkey") * 7) % 50).alias("citations"), (c("o_orderstatus") == "P").alias("preprint"),
        F.concat("c_mktsegment", "c_nationkey").alias("institution"), c("c_nationkey").alias("country"), F.when(c("o_orderkey") % 3 != 0, (c("o_orderkey") % 4) / 4).alias("industry_share"),
    )


def patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    name = F.concat(F.lit("sup"), c("l_suppkey") % 40)
    assignee = F.when(c("l_suppkey") % 11 == 0, "").when(c("l_orderkey") % 2 == 0, F.upper(name)).otherwise(name)
    return table(spark, sf_dir, "lineitem").select((c("l_partkey") % N_TECH).alias("tech_id"), F.to_date("l_shipdate").alias("priority"), assignee.alias("assignee"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, h = F.col, F.col("o_orderkey") % 17
    rows = table(spark, sf_dir, "orders").where(c("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return rows.select(
        (c("o_custkey") % N_TECH).alias("tech_id"), F.to_date("o_orderdate").alias("published"), F.when(h == 0, "").otherwise(F.concat(F.lit("h"), h)).alias("host"), F.concat(F.lit("Pub"), c("o_custkey") % 5).alias("publisher"),
        h.isin(1, 2).alias("press"), h.isin(3, 4, 5).alias("high_trust"), h.isin(0, 6).alias("unverifiable"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    name = F.concat(F.lit("Co "), c("l_suppkey") % 20)
    return table(spark, sf_dir, "lineitem").select(
        (c("l_partkey") % N_TECH).alias("tech_id"), F.element_at(F.array(*map(F.lit, KINDS)), c("l_linenumber")).alias("type"), F.to_date("l_shipdate").alias("day"),
        F.when(c("l_suppkey") % 3 == 0, F.upper(name)).when(c("l_suppkey") % 3 == 1, F.concat(name, F.lit(" "))).otherwise(name).alias("company"),
        F.when(c("l_orderkey") % 4 != 0, F.concat(F.lit("Cust"), c("l_orderkey") % 30)).alias("customer"), (c("l_extendedprice") / 1000).alias("amount_usd_m"),
        F.element_at(F.array(*map(F.lit, ROUNDS)), (c("l_quantity").cast("int") % 7) + 1).alias("round"), (c("l_tax") >= 0.05).alias("strategic"),
        F.concat_ws("-", F.lpad(c("l_orderkey").cast("string"), 12, "0"), F.lpad(c("l_partkey").cast("string"), 12, "0"), F.lpad(c("l_suppkey").cast("string"), 12, "0"), F.lpad(c("l_linenumber").cast("string"), 3, "0"), F.lpad((c("l_extendedprice") * 100).cast("long").cast("string"), 12, "0")).alias("event_id"),
    )


def status(spark: SparkSession) -> DataFrame:
    t = F.col("tech_id")
    return spark.range(N_TECH).select(F.col("id").alias("tech_id")).select(
        "tech_id", F.concat(F.lit("d"), t % 3).alias("domain"), (t % 7 != 3).alias("science_ok"), (t % 5 != 2).alias("patents_ok"), (t % 6 != 4).alias("media_ok"), (t % 2 == 0).alias("events_read")
    )


def judged(spark: SparkSession) -> DataFrame:
    t = F.col("id")
    return spark.range(N_TECH).select(
        t.alias("tech_id"), F.when(t % 6 != 0, t % 6).alias("stage"), F.when(t % 4 != 2, t % 4 == 1).alias("mass_market"), (t % 8 != 7).alias("is_technology"), F.when(t % 9 != 0, t / 10).alias("rebranding_similarity")
    )


# The same relations in SQL. Windows: 2, 3, 4, 6, 10 years are 730, 1096, 1461, 2192, 3652 days; half years 183 and 548.
RELATIONS = """s AS (SELECT DATE '2001-06-30' AS s),
works AS (SELECT o_custkey % 25 AS tech_id, o_orderdate::DATE AS d, (o_orderkey * 7) % 50 AS citations, o_orderstatus = 'P' AS preprint, c_mktsegment || c_nationkey AS institution, c_nationkey AS country,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 4) / 4.0::DOUBLE END AS industry FROM orders JOIN customer ON o_custkey = c_custkey),
pats AS (SELECT l_partkey % 25 AS tech_id, l_shipdate::DATE AS d, CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE 'sup' || (l_suppkey % 40) END AS a FROM lineitem),
news AS (SELECT o_custkey % 25 AS tech_id, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 17 = 0 THEN 'pub' || (o_custkey % 5) ELSE 'h' || (o_orderkey % 17) END AS label, o_orderkey % 17 AS h FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
ev0 AS (SELECT l_partkey % 25 AS tech_id, ['pilot', 'deployment', 'product', 'funding', 'grant', 'regulation', 'procurement'][l_linenumber] AS type, l_shipdate::DATE AS day,
  CASE l_suppkey % 3 WHEN 0 THEN upper('Co ' || (l_suppkey % 20)) WHEN 1 THEN 'Co ' || (l_suppkey % 20) || ' ' ELSE 'Co ' || (l_suppkey % 20) END AS company, CASE WHEN l_orderkey % 4 <> 0 THEN 'Cust' || (l_orderkey % 30) END AS customer,
  l_extendedprice / 1000 AS amount, lower(['pre-seed', 'seed', 'A', 'b', 'C', 'd+', 'x'][1 + l_quantity::INT % 7]) AS round, l_tax >= 0.05 AS strategic,
  row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS id FROM lineitem),
ev AS (SELECT tech_id, type, day, arg_min(company, id) AS company, arg_min(customer, id) AS customer, arg_min(amount, id) AS amount, arg_min(round, id) AS round, arg_min(strategic, id) AS strategic
  FROM ev0, s WHERE day <= s GROUP BY tech_id, type, day, lower(trim(company)), coalesce(lower(trim(customer)), '')),
sci AS (SELECT tech_id, count_if(d >= s - 730) AS s0, count_if(d BETWEEN s - 1461 AND s - 731) AS s1, count_if(d BETWEEN s - 2192 AND s - 1462) AS s2, count_if(d >= s - 1096) AS s_3y, count(*) AS s_total, min(d) AS s_first,
  round(median(CASE WHEN d >= s - 730 THEN citations / greatest(1, (year(s) - year(d)) * 12 + month(s) - month(d)) END), 6) AS citation_velocity_median, round(avg(CASE WHEN d >= s - 730 THEN preprint::INT END), 6) AS preprint_share_2y,
  nullif(count(DISTINCT CASE WHEN d >= s - 1096 THEN institution END), 0) AS n_institutions, nullif(count(DISTINCT CASE WHEN d >= s - 1096 THEN country END), 0) AS n_countries,
  round(avg(CASE WHEN d >= s - 1096 THEN industry END), 6) AS industry_affiliation_share_3y FROM works, s WHERE d <= s GROUP BY tech_id),
pa AS (SELECT tech_id, count_if(d BETWEEN s - 548 - 730 AND s - 548) AS p0, count_if(d BETWEEN s - 548 - 1461 AND s - 548 - 731) AS p1, count_if(d BETWEEN s - 548 - 2192 AND s - 548 - 1462) AS p2, count_if(d >= s - 1096) AS p_3y,
  count_if(d < s - 548 - 2192) AS p_older, count_if(d < s - 3652) AS p_older10 FROM pats, s WHERE d <= s GROUP BY tech_id),
pn AS (SELECT tech_id, a, count_if(d >= s - 1096) AS now, count_if(d < s - 1096) AS before FROM pats, s WHERE d <= s AND a <> '' GROUP BY ALL),
ph AS (SELECT tech_id, round(avg((before = 0)::INT), 6) AS patent_new_assignee_share_3y, count(*) AS n_assignees, round(sum(now * now) / (sum(now) * sum(now))::DOUBLE, 6) AS patent_assignee_hhi_3y FROM pn WHERE now > 0 GROUP BY tech_id),
pt AS (SELECT pa.*, patent_new_assignee_share_3y, n_assignees, patent_assignee_hhi_3y, CASE WHEN p_older10 > 0 THEN s - 5479 WHEN p_older - p_older10 > 0 THEN s - 3287 WHEN p2 > 0 THEN s - 2374 WHEN p1 > 0 THEN s - 1644 WHEN p0 > 0 THEN s - 913 WHEN p_3y > 0 THEN s - 365 END AS p_first
  FROM pa LEFT JOIN ph USING (tech_id), s),
nw AS (SELECT tech_id, count_if(d >= s - 183) AS n0, count_if(d BETWEEN s - 365 AND s - 184) AS n1, count_if(d BETWEEN s - 730 AND s - 366) AS n2, count_if(d BETWEEN s - 1461 AND s - 731) AS n3, min(d) AS n_first,
  count(DISTINCT CASE WHEN d >= s - 365 AND h NOT IN (1, 2) THEN label END) AS n_independent, count(DISTINCT CASE WHEN d >= s - 365 AND h IN (3, 4, 5) THEN label END) AS n_high,
  round(avg(CASE WHEN d >= s - 365 THEN (h IN (1, 2))::INT END), 6) AS press_release_share_12m, round(avg(CASE WHEN d >= s - 365 THEN (h IN (0, 6))::INT END), 6) AS unverifiable_source_share FROM news, s WHERE d BETWEEN s - 1461 AND s GROUP BY tech_id),
spine AS (SELECT strftime(m, '%Y-%m') AS m FROM s, unnest(generate_series(date_trunc('month', s - 365), s, INTERVAL 1 MONTH)) AS t(m)),
nm AS (SELECT tech_id, strftime(d, '%Y-%m') AS m, count(*) AS c FROM news, s WHERE d BETWEEN s - 365 AND s GROUP BY ALL),
nb AS (SELECT tech_id, round((stddev_pop(v) - avg(v)) / (stddev_pop(v) + avg(v)), 6) AS media_burstiness_12m FROM (SELECT t.tech_id, coalesce(c, 0) AS v FROM (SELECT DISTINCT tech_id FROM nm) t CROSS JOIN spine LEFT JOIN nm ON nm.tech_id = t.tech_id AND nm.m = spine.m) GROUP BY tech_id),
nh AS (SELECT tech_id, round(sum(c * c) / (sum(c) * sum(c))::DOUBLE, 6) AS source_organization_hhi FROM (SELECT tech_id, label, count(*) AS c FROM news, s WHERE d BETWEEN s - 365 AND s GROUP BY ALL) GROUP BY tech_id),
me AS (SELECT nw.*, media_burstiness_12m, source_organization_hhi FROM nw LEFT JOIN nb USING (tech_id) LEFT JOIN nh USING (tech_id)),
e1 AS (SELECT tech_id, count(*) AS e_total, min(CASE WHEN type IN ('pilot', 'deployment', 'product', 'funding') THEN day END) AS e_first,
  count(DISTINCT CASE WHEN type = 'pilot' AND day >= s - 730 THEN (company, coalesce(customer, ''), strftime(day, '%Y-%m')) END) AS n_pilots, count(DISTINCT CASE WHEN type = 'deployment' THEN (company, coalesce(customer, ''), strftime(day, '%Y-%m')) END) AS n_deployments,
  count(DISTINCT CASE WHEN type IN ('pilot', 'deployment', 'product', 'funding') THEN lower(trim(company)) END) AS n_vendors, count(DISTINCT lower(trim(customer))) AS n_customers, 0 AS final_standard_flag, count_if(type = 'regulation') AS regulatory_precursor_count,
  max((type = 'procurement')::INT) AS procurement_presence, coalesce(sum(CASE WHEN type = 'funding' AND day >= s - 730 THEN amount END), 0) AS sum24, coalesce(sum(CASE WHEN type = 'funding' AND day < s - 730 THEN amount END), 0) AS sum_older,
  count_if(type = 'funding' AND day >= s - 730) AS funding_round_count_24m, round(avg(CASE WHEN type = 'funding' AND day >= s - 730 AND round IN ('pre-seed', 'seed', 'a', 'b', 'c', 'd+') THEN (round IN ('pre-seed', 'seed', 'a'))::INT END), 6) AS early_stage_funding_share,
  count_if(type = 'funding' AND day >= s - 730 AND strategic) AS strategic_investor_count, count_if(type = 'grant' AND day >= s - 1096) AS n_grants, bool_or(type IN ('funding', 'grant')) AS has_funding,
  bool_or(type IN ('pilot', 'deployment', 'product', 'procurement')) AS has_adoption, bool_or(type = 'funding' AND day >= s - 730) AS has_funding_24m FROM ev, s GROUP BY tech_id),
eh AS (SELECT tech_id, round(sum(c * c) / (sum(c) * sum(c))::DOUBLE, 6) AS funding_company_hhi FROM (SELECT tech_id, lower(company) AS x, count(*) AS c FROM ev, s WHERE type = 'funding' AND day >= s - 730 AND trim(company) <> '' GROUP BY ALL) GROUP BY tech_id),
en AS (SELECT e1.*, funding_company_hhi FROM e1 LEFT JOIN eh USING (tech_id))
"""


@query(f"WITH {RELATIONS} SELECT * FROM sci")
def science_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.science(works(spark, sf_dir), SNAPSHOT)


@query(f"WITH {RELATIONS} SELECT * FROM pt")
def patent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.patents(patents(spark, sf_dir), SNAPSHOT)


@query(f"WITH {RELATIONS} SELECT * FROM me")
def media_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.media(news(spark, sf_dir), SNAPSHOT)


@query(f"WITH {RELATIONS} SELECT * REPLACE (round(sum24, 4) AS sum24, round(sum_older, 4) AS sum_older) FROM en")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.events(events(spark, sf_dir), SNAPSHOT).withColumns({c: F.round(c, 4) for c in ("sum24", "sum_older")})


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_vector(SNAPSHOT, status(spark), works(spark, sf_dir), patents(spark, sf_dir), news(spark, sf_dir), events(spark, sf_dir), judged(spark))


def _vector_sql() -> str:
    log = "round(ln(1 + {}), 6)"
    grow = "round(ln(1 + {}) - ln(1 + {}), 6)"
    sg, pg = grow.format("s0", "s1"), grow.format("p0", "p1")
    age = "round(datediff('day', {}, s) / 365.25, 3)"
    have = "(e_total > 0 OR (tech_id % 2 = 0 AND med))"
    when = lambda ok, x: f"CASE WHEN {ok} THEN {x} END"
    names = features.FEATURES
    v = {n: "NULL" for n in names}
    v |= {n: when("stage IS NOT NULL", f"(stage = {k})::INT") for k, n in enumerate(names[:5], 1)}
    v |= {
        "first_evidence_age_years": age.format("least(CASE WHEN sci THEN s_first END, CASE WHEN pat THEN p_first END, CASE WHEN med THEN n_first END)"),
        "first_commercial_event_age_years": when(have, age.format("e_first")), "verified_pilots_log_24m": when(have, log.format("n_pilots")), "production_deployments_log": when(have, log.format("n_deployments")),
        "commercial_vendor_count_log": when(have, log.format("n_vendors")), "named_customer_count_log": when(have, log.format("n_customers")), "final_standard_flag": when(have, "0"),
        "regulatory_precursor_count": when(have, "regulatory_precursor_count"), "procurement_presence": when(have, "procurement_presence"), "mass_market_flag": when("tech_id % 4 <> 2", "(tech_id % 4 = 1)::INT"),
        "papers_log_3y": when("sci", log.format("s_3y")), "paper_growth_2y": when("sci", sg), "paper_acceleration": when("sci", f"round({sg} - {grow.format('s1', 's2')}, 6)"),
        "citation_velocity_median": when("sci", "citation_velocity_median"), "preprint_share_2y": when("sci", "preprint_share_2y"), "institution_count_log_3y": when("sci", log.format("n_institutions")),
        "industry_affiliation_share_3y": when("sci", "industry_affiliation_share_3y"), "science_country_count_log_3y": when("sci", log.format("n_countries")), "patent_families_log_3y": when("pat", log.format("p_3y")),
        "patent_growth_2y": when("pat", pg), "patent_acceleration": when("pat", f"round({pg} - {grow.format('p1', 'p2')}, 6)"), "patent_first_priority_age_years": when("pat", age.format("p_first")),
        "patent_new_assignee_share_3y": when("pat", "patent_new_assignee_share_3y"), "patent_assignee_count_log_3y": when("pat", log.format("n_assignees")), "patent_assignee_hhi_3y": when("pat", "patent_assignee_hhi_3y"),
        "media_volume_normalized_12m": when("med", "round(ln(1 + n0 + n1) / ln(201), 6)"), "media_growth_6m": when("med", grow.format("n0", "n1")), "media_burstiness_12m": when("med", "media_burstiness_12m"),
        "independent_media_domains_log_12m": when("med", log.format("n_independent")), "press_release_share_12m": when("med", "press_release_share_12m"), "independent_high_trust_source_count_log": when("med", log.format("n_high")),
        "unverifiable_source_share": when("med", "unverifiable_source_share"), "source_organization_hhi": when("med", "source_organization_hhi"), "funding_log_24m": when(have, log.format("sum24")),
        "funding_growth_24m": when(have, grow.format("sum24", "sum_older")), "funding_round_count_24m": when(have, "funding_round_count_24m"), "early_stage_funding_share": when(have, "early_stage_funding_share"),
        "strategic_investor_count": when(have, "strategic_investor_count"), "funding_company_hhi": when(have, "funding_company_hhi"), "public_grants_log_36m": when(have, log.format("n_grants")),
        "is_technology_flag": "(tech_id % 8 <> 7)::INT", "rebranding_similarity_to_mature": when("tech_id % 9 <> 0", "least(tech_id / 10.0::DOUBLE, 1)"), "patent_to_paper_ratio": when("sci AND pat", grow.format("p_3y", "s_3y")),
        "patent_minus_paper_growth": when("sci AND pat", f"round({pg} - {sg}, 6)"), "media_to_technical_evidence_ratio": when("med AND (sci OR pat)", grow.format("n0 + n1", "(CASE WHEN sci THEN s_3y ELSE 0 END) + (CASE WHEN pat THEN p_3y ELSE 0 END)")),
        "source_type_diversity": "c1::INT + c2::INT + c3::INT + c4::INT + c5::INT",
        "cross_channel_confirmation_count": f"(sci AND s0 >= 2 AND s0 > s1)::INT + (pat AND p0 >= 2 AND p0 > p1)::INT + (med AND n0 >= 2 AND n0 > n1)::INT + ({have} AND has_funding_24m)::INT",
        "first_time_convergence_flag": when("sci AND pat AND med", "(s0 > 0 AND p0 > 0 AND n0 + n1 > 0 AND (s1 = 0)::INT + (p1 = 0)::INT + (n2 + n3 = 0)::INT >= 2)::INT"),
        **{f"missing_{n}": f"1 - c{k}::INT" for k, n in enumerate(("science", "patents", "media", "funding", "adoption"), 1)},
    }
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("s0", "s1", "s2", "s_3y", "s_total", "p0", "p1", "p2", "p_3y", "p_older", "n0", "n1", "n2", "n3", "n_independent", "n_high", "e_total", "n_pilots", "n_deployments", "n_vendors", "n_customers", "regulatory_precursor_count", "procurement_presence", "sum24", "sum_older", "funding_round_count_24m", "strategic_investor_count", "n_grants"))
    rest = ", ".join(("s_first", "citation_velocity_median", "preprint_share_2y", "n_institutions", "n_countries", "industry_affiliation_share_3y", "p_first", "patent_new_assignee_share_3y", "n_assignees", "patent_assignee_hhi_3y", "n_first", "press_release_share_12m", "unverifiable_source_share", "media_burstiness_12m", "source_organization_hhi", "e_first", "early_stage_funding_share", "funding_company_hhi"))
    chosen = ", ".join(f"({v[n]})::DOUBLE AS {n}" for n in names)
    return f"""WITH {RELATIONS},
j AS (SELECT t AS tech_id, s, 'd' || (t % 3) AS domain, nullif(t % 6, 0) AS stage, t % 7 <> 3 AS sci, t % 5 <> 2 AS pat, t % 6 <> 4 AS med, {zero}, {rest},
  coalesce(has_funding, false) AS c4, coalesce(has_adoption, false) AS c5, coalesce(has_funding_24m, false) AS has_funding_24m
  FROM s, range(25) AS r(t) LEFT JOIN sci ON sci.tech_id = t LEFT JOIN pt ON pt.tech_id = t LEFT JOIN me ON me.tech_id = t LEFT JOIN en ON en.tech_id = t),
k AS (SELECT *, sci AND s_total > 0 AS c1, pat AND p0 + p1 + p2 + p_3y + p_older > 0 AS c2, med AND n0 + n1 + n2 + n3 > 0 AS c3 FROM j),
f AS (SELECT tech_id, domain, {chosen} FROM k),
o AS (SELECT tech_id, cume_dist() OVER (PARTITION BY domain ORDER BY papers_log_3y) AS own, count(*) OVER (PARTITION BY domain) AS n, cume_dist() OVER (ORDER BY papers_log_3y) AS every FROM f WHERE papers_log_3y IS NOT NULL)
SELECT f.* REPLACE (round(CASE WHEN n >= 20 THEN own ELSE every END, 6) AS paper_volume_percentile_domain) FROM f LEFT JOIN o USING (tech_id)"""


@query(_vector_sql())
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector(spark, sf_dir)


# A small artifact over measured features; its numbers are examples, not a trained model.
INPUTS = ("papers_log_3y", "paper_growth_2y", "patent_growth_2y", "media_growth_6m", "media_burstiness_12m", "source_organization_hhi", "funding_log_24m", "missing_science", "missing_media", "stage_pilot", "mass_market_flag")
MODEL = scoring.Artifact(
    INPUTS, (4.0, 0.0, 0.0, 0.0, -0.6, 0.1, 5.0, 0.0, 0.0, 0.0, 0.0), (4.1, 0.02, 0.01, 0.03, -0.55, 0.09, 4.9, 0.1, 0.1, 0.2, 0.3), (0.5, 0.2, 0.3, 0.4, 0.1, 0.05, 0.7, 0.3, 0.3, 0.4, 0.45),
    (0.3, 0.9, 0.4, 0.7, -0.2, -0.5, 0.6, -0.8, -0.4, 0.5, -1.1), -0.2, 1.3, -0.02,
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(vector(spark, sf_dir), MODEL)


def _parts_sql() -> list[str]:
    return [f"{MODEL.a * MODEL.coef[k]}::DOUBLE * (coalesce({n}, {MODEL.median[k]}::DOUBLE) - {MODEL.mean[k]}::DOUBLE) / {MODEL.scale[k]}::DOUBLE" for k, n in enumerate(INPUTS)]


LOGIT_SQL = f"({MODEL.a * MODEL.intercept + MODEL.b}::DOUBLE + " + " + ".join(_parts_sql()) + ")"
REASONS_SQL = """list_filter([CASE WHEN stage_scaling_or_mature = 1 THEN 'scaling_or_mature' END, CASE WHEN mass_market_flag = 1 THEN 'mass_market' END, CASE WHEN is_technology_flag = 0 THEN 'not_a_technology' END, CASE WHEN final_standard_flag = 1 THEN 'final_standard' END,
 CASE WHEN first_evidence_age_years >= 15 AND paper_growth_2y <= 0 THEN 'old_and_not_growing' END, CASE WHEN missing_science = 1 AND missing_media = 1 THEN 'no_science_or_media' END, CASE WHEN unverifiable_source_share >= 0.7 THEN 'mostly_unverifiable' END], lambda x: x IS NOT NULL)"""


@query(f"WITH v AS ({_vector_sql()}) SELECT tech_id, round({LOGIT_SQL}, 6) AS logit, round(1 / (1 + exp(-{LOGIT_SQL})), 6) AS probability, 1 / (1 + exp(-{LOGIT_SQL})) >= 0.42 AS is_signal, 1 / (1 + exp(-{LOGIT_SQL})) > 0.75 AS confident FROM v")
def scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("tech_id", F.round("logit", 6).alias("logit"), F.round("probability", 6).alias("probability"), "is_signal", "confident")


_UNPIVOT = " UNION ALL ".join(f"SELECT tech_id, '{n}' AS feature, round({p}, 4) AS contribution FROM v" for n, p in zip(INPUTS, _parts_sql(), strict=True))


@query(f"""WITH v AS ({_vector_sql()}), c AS ({_UNPIVOT}), r AS (SELECT *, row_number() OVER (PARTITION BY tech_id, contribution > 0 ORDER BY abs(contribution) DESC, feature) AS k FROM c WHERE contribution <> 0)
SELECT tech_id, feature, contribution, contribution > 0 AS speaks_for, k AS place FROM r WHERE k <= 5""")
def contributions_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    out = [rows.select("tech_id", F.posexplode(name)).select("tech_id", "col.feature", "col.contribution", F.lit(sign).alias("speaks_for"), (F.col("pos") + 1).cast("long").alias("place")) for name, sign in (("top_for", True), ("top_against", False))]
    return out[0].unionByName(out[1])


@query(f"""WITH v AS ({_vector_sql()}), c AS ({_UNPIVOT} UNION ALL SELECT tech_id, 'baseline', round({MODEL.a * MODEL.intercept + MODEL.b}::DOUBLE, 4) FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY tech_id ORDER BY feature <> 'baseline', abs(contribution) DESC, feature) AS step FROM c)
SELECT tech_id, step, feature, contribution, round(sum(contribution) OVER (PARTITION BY tech_id ORDER BY step), 4) AS running FROM o""")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = scored(spark, sf_dir).select("tech_id", F.posexplode("waterfall")).select("tech_id", (F.col("pos") + 1).cast("long").alias("step"), "col.feature", "col.contribution")
    return steps.withColumn("running", F.round(F.sum("contribution").over(Window.partitionBy("tech_id").orderBy("step")), 4))


@query(f"""WITH v AS ({_vector_sql()}), p AS (SELECT *, 1 / (1 + exp(-{LOGIT_SQL})) AS p, {REASONS_SQL} AS reasons, ['weak_signal', 'mature', 'irrelevant', 'insufficient_evidence'][1 + tech_id % 4] AS judged, tech_id % 10 <> 9 AS scored FROM v)
SELECT tech_id, array_to_string(reasons, ',') AS reasons, CASE WHEN NOT scored THEN CASE WHEN judged = 'weak_signal' THEN 'insufficient_evidence' ELSE judged END WHEN judged = 'irrelevant' THEN judged
 WHEN p < 0.42 THEN CASE WHEN list_has_any(reasons, ['scaling_or_mature', 'mass_market', 'final_standard', 'old_and_not_growing']) THEN 'mature' ELSE 'hype_or_noise' END WHEN tech_id % 3 = 2 THEN 'insufficient_evidence' WHEN tech_id % 5 = 4 THEN 'insufficient_evidence' ELSE 'weak_signal' END AS verdict FROM p""")
def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tech_id")
    rows = scored(spark, sf_dir).withColumn("why", scoring.exclusion_reasons())
    said = F.element_at(F.array(*map(F.lit, ("weak_signal", "mature", "irrelevant", "insufficient_evidence"))), (t % 4 + 1).cast("int"))
    verdict = scoring.decide(said, t % 10 != 9, F.col("is_signal"), F.col("why"), t % 3 != 2, t % 5 != 4)
    return rows.select("tech_id", F.array_join("why", ",").alias("reasons"), verdict.alias("verdict"))


@query("""WITH v AS (SELECT p_partkey, ['strong', 'partial', 'unknown', 'contradictory'][1 + p_size % 4] AS a, ['strong', 'partial', 'unknown', 'contradictory'][1 + p_partkey % 4] AS b, ['strong', 'partial', 'unknown', 'contradictory'][1 + (p_size + p_partkey) % 4] AS c FROM part),
w(v, x) AS (VALUES ('strong', 1.0::DOUBLE), ('partial', 0.5::DOUBLE), ('unknown', 0.0::DOUBLE), ('contradictory', 0.0::DOUBLE))
SELECT p_partkey, round_even(30 * wa.x + 25 * wb.x + 20 * wc.x + 25 * wa.x, 0)::INT AS rubric FROM v JOIN w wa ON wa.v = a JOIN w wb ON wb.v = b JOIN w wc ON wc.v = c""")
def rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("strong", "partial", "unknown", "contradictory")))
    pick = lambda x: F.element_at(names, (x % 4 + 1).cast("int"))
    a, b, c = pick(F.col("p_size")), pick(F.col("p_partkey")), pick(F.col("p_size") + F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", scoring.rubric_score({"early_stage": a, "novelty": b, "momentum": c, "evidence": a}).alias("rubric"))


EVENT_SNAPSHOT = "2024-01-31"


@query("""WITH e AS (SELECT event_type || '-' || (user_id % 8) AS tech, user_id, ts::DATE AS d FROM events WHERE ts::DATE <= DATE '2024-01-31'),
w AS (SELECT tech, count_if(d > DATE '2024-01-24') AS w0, count_if(d BETWEEN DATE '2024-01-18' AND DATE '2024-01-24') AS w1, count_if(d BETWEEN DATE '2024-01-11' AND DATE '2024-01-17') AS w2, count(*) AS total, min(d) AS first_day FROM e GROUP BY tech),
spine AS (SELECT d::DATE AS d FROM generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY) AS t(d)),
b AS (SELECT tech, avg(n) AS mu, stddev_pop(n) AS sd FROM (SELECT t.tech, spine.d, count(e.tech) AS n FROM (SELECT DISTINCT tech FROM e) t CROSS JOIN spine LEFT JOIN e ON e.tech = t.tech AND e.d = spine.d GROUP BY ALL) GROUP BY tech),
h AS (SELECT tech, round(sum(c * c) / (sum(c) * sum(c))::DOUBLE, 6) AS hhi FROM (SELECT tech, user_id, count(*) AS c FROM e GROUP BY ALL) GROUP BY tech),
f AS (SELECT w.*, round(ln(1 + w0) - ln(1 + w1), 6) AS growth, round(round(ln(1 + w0) - ln(1 + w1), 6) - round(ln(1 + w1) - ln(1 + w2), 6), 6) AS acceleration, round((sd - mu) / (sd + mu), 6) AS burst, hhi, round(datediff('day', first_day, DATE '2024-01-31') / 365.25, 3) AS age FROM w JOIN b USING (tech) JOIN h USING (tech)),
p AS (SELECT *, round(1 / (1 + exp(-(1.5::DOUBLE * growth + 0.8::DOUBLE * acceleration + 0.4::DOUBLE * burst - 2.0::DOUBLE * hhi + 0.05::DOUBLE * ln(1 + total)))), 6) AS probability FROM f)
SELECT *, row_number() OVER (ORDER BY probability DESC, tech) AS rank FROM p QUALIFY rank <= 15""")
def signal_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per technology: windowed activity, growth, burstiness, concentration and age, to a probability and the first 15."""
    from emberline.operators.ranking import shortlist

    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.col("user_id") % 8).alias("tech"), "user_id", F.to_date("ts").alias("d")).where(F.col("d") <= EVENT_SNAPSHOT)
    daily = e.groupBy("tech", "user_id", "d").agg(F.count(F.lit(1)).alias("n"))
    between = lambda a, b: F.coalesce(F.sum(F.when(F.col("d").between(a, b), F.col("n"))), F.lit(0))
    w = daily.groupBy("tech").agg(between("2024-01-25", EVENT_SNAPSHOT).alias("w0"), between("2024-01-18", "2024-01-24").alias("w1"), between("2024-01-11", "2024-01-17").alias("w2"), F.sum("n").alias("total"), F.min("d").alias("first_day"))
    by_day = daily.groupBy("tech", "d").agg(F.sum("n").cast("double").alias("n")).groupBy("tech").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("c"))
    days = F.sequence(F.lit("2024-01-02").cast("date"), F.lit(EVENT_SNAPSHOT).cast("date"))
    burst = by_day.select("tech", burstiness(F.transform(days, lambda x: F.coalesce(F.try_element_at("c", x), F.lit(0.0)))).alias("burst"))
    users = daily.groupBy("tech", "user_id").agg(F.sum("n").cast("double").alias("c")).groupBy("tech").agg(F.round(F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c")), 6).alias("hhi"))
    grow = growth(F.col("w0"), F.col("w1"))
    f = w.join(burst, "tech").join(users, "tech").withColumns({"growth": grow, "acceleration": F.round(grow - growth(F.col("w1"), F.col("w2")), 6), "age": F.round(F.datediff(F.lit(EVENT_SNAPSHOT).cast("date"), "first_day") / 365.25, 3)})
    logit = 1.5 * F.col("growth") + 0.8 * F.col("acceleration") + 0.4 * F.col("burst") - 2.0 * F.col("hhi") + 0.05 * F.log1p(F.col("total").cast("double"))
    return shortlist(f.withColumn("probability", F.round(sigmoid(logit), 6)), [F.col("probability").desc(), F.col("tech")], 15)


@query("""WITH o AS (SELECT o_orderpriority AS domain, o_custkey % 60 AS tech, count(*) AS n FROM orders GROUP BY ALL)
SELECT domain, tech, round(ln(1 + n), 6) AS papers_log_3y, round(CASE WHEN count(*) OVER (PARTITION BY domain) >= 20 THEN cume_dist() OVER (PARTITION BY domain ORDER BY round(ln(1 + n), 6)) ELSE cume_dist() OVER (ORDER BY round(ln(1 + n), 6)) END, 6) AS paper_volume_percentile_domain FROM o""")
def percentile_in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("domain"), (F.col("o_custkey") % 60).alias("tech")).agg(F.count(F.lit(1)).alias("n"))
    return features.percentile_in_domain(rows.select("domain", "tech", log6(F.col("n")).alias("papers_log_3y")))
