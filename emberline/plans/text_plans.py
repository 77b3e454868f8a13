"""Text and URL queries over documents, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import dates, money, text, urls
from emberline.operators.proximity import near_pairs
from emberline.plans.base import query
from emberline.session import table

FOLD = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
TOK = "regexp_extract_all(lower({}), '[a-z0-9а-яё][a-z0-9а-яё+\\-]*')"
STEM = (
    "CASE WHEN regexp_matches(w, '[\\x{0400}-\\x{04ff}]') THEN substr(w, 1, 5) WHEN length(w) > 6 AND ends_with(w, 'ies') THEN substr(w, 1, length(w) - 3)"
    " WHEN length(w) > 5 AND ends_with(w, 'es') THEN substr(w, 1, length(w) - 2) WHEN length(w) > 4 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1)"
    " WHEN length(w) > 4 AND ends_with(w, 'y') THEN substr(w, 1, length(w) - 1) ELSE w END"
)


def sql_stems(x: str) -> str:
    return f"list_transform({TOK.format(x)}, lambda w: {STEM})"


def sql_key_stems(x: str) -> str:
    return f"list_distinct(list_transform(list_filter({TOK.format(x)}, lambda t: length(t) > 1 AND t NOT IN ({text.quoted(text.GENERIC)})), lambda w: {STEM}))"


@query(r"""
WITH u AS (SELECT page_id, trim(url) AS u FROM pages),
p AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) AS net,
  regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\?([^#]*)', 1) AS q FROM u),
f AS (SELECT *, array_to_string(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid')),
  lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') AS kept FROM p)
SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND net <> '' AND NOT contains(net, '@') AND regexp_extract(net, ':(\d*)$', 1) IN ('', '80', '443')
  THEN scheme || '://' || net || (CASE WHEN path = '' THEN '/' ELSE path END) || (CASE WHEN kept <> '' THEN '?' || kept ELSE '' END) END AS canonical FROM f""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '')
  || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN contains(url, '?') AND regexp_extract(url, '\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS url_key,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages""")
def url_keys_and_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.url_key(F.col("url")).alias("url_key"), urls.host_of(F.col("url")).alias("host"))


@query(r"""WITH h AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages)
SELECT host, length(host) <= 253 AND regexp_matches(host, '^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$') AS ok FROM h""")
def domain_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(urls.host_of(F.col("url")).alias("host")).distinct()
    return hosts.select("host", urls.valid_domain(F.col("host")).alias("ok"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query(f"SELECT doc_id, sha256({FOLD.format('text')}) AS content_hash FROM documents")
def text_norm_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS cleaned FROM documents")
def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.clean_text(F.col("text")), 256).alias("cleaned"))


def _script_sql() -> str:
    ranges = {"latin": "A-Za-zÀ-ÖØ-öø-ÿ", "cyrillic": r"\x{0400}-\x{04FF}", "greek": r"\x{0370}-\x{03FF}", "arabic": r"\x{0600}-\x{06FF}", "hebrew": r"\x{0590}-\x{05FF}", "han": r"\x{4E00}-\x{9FFF}", "kana": r"\x{3040}-\x{30FF}"}
    return "SELECT doc_id, " + ", ".join(f"length(text) - length(regexp_replace(text, '[{r}]', '', 'g')) AS {s}" for s, r in ranges.items()) + " FROM documents"


@query(_script_sql())
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[text.script_count(F.col("text"), s).alias(s) for s in text.SCRIPTS])


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[А-Яа-яЁё]')) > greatest(len(regexp_extract_all(text, '[A-Za-z]')), 20) THEN 'ru' ELSE 'unknown' END AS hint FROM documents")
def language_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.language_hint(F.col("text")).alias("hint"))


@query(r"""SELECT p_partkey, trim(regexp_replace(replace(lower(p_name || ' ' || p_brand), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key,
  'cand_' || substr(sha256(trim(regexp_replace(replace(lower(p_name || ' ' || p_brand), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g'))), 1, 12) AS id FROM part""")
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.candidate_key(F.concat_ws(" ", "p_name", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key")).select("p_partkey", "key", F.concat(F.lit("cand_"), F.substr(F.sha2("key", 256), F.lit(1), F.lit(12))).alias("id"))


@query(r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name || 's and ' || p_type || ' Process'), '[\p{L}\p{N}]+'),
  lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN substr(w, 1, length(w) - 1) ELSE w END), ' ') AS term FROM part""")
def term_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.norm_term(F.concat(F.col("p_name"), F.lit("s and "), F.col("p_type"), F.lit(" Process"))).alias("term"))


@query(f"SELECT doc_id, sha256(array_to_string({sql_stems('text')}, ' ')) AS stems FROM documents")
def light_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(text.stems(F.col("text")), " "), 256).alias("stems"))


def _phrases(name: str) -> str:
    words = f"list_filter({TOK.format(name)}, lambda t: length(t) > 1 AND t NOT IN ({text.quoted(text.GENERIC)}))[1:3]"
    return f"""WITH k AS (SELECT item_id, {words} AS w FROM benchmark WHERE NOT regexp_matches(text, '[\\x{{0400}}-\\x{{04ff}}]'))
SELECT item_id, array_to_string(CASE WHEN len(w) = 0 THEN [] WHEN len(w) > 2 THEN list_sort(list_distinct([array_to_string(w, ' '), array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')])) ELSE [array_to_string(w, ' ')] END, '|') AS phrases FROM k"""


@query(_phrases("text"))
def short_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(text.short_phrases(F.col("text"))), "|").alias("phrases"))


@query(f"""SELECT doc_id, item_id FROM documents d, benchmark b WHERE length(trim(b.text)) >= 20 AND contains({FOLD.format('d.text')}, {FOLD.format('b.text')})""")
def quote_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items quoted in documents. A quote's first four words are an anchor that both sides join on, so no pair is formed that shares none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.normalized_text(F.col("text")).alias("body"))
    items = table(spark, sf_dir, "benchmark").where(F.length(F.trim("text")) >= 20).select("item_id", text.normalized_text(F.col("text")).alias("quote"))
    words = F.split("quote", " ")
    inner = F.slice(words, 2, 4)  # whole words: the first may be the end of a longer one in the document
    items = items.withColumn("anchor", F.xxhash64(F.array_join(inner, " ")))
    spread = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 4), " ")))
    places = docs.select("doc_id", F.split("body", " ").alias("w")).select("doc_id", F.explode(F.array_distinct(spread)).alias("anchor"))
    met = places.join(items, "anchor").select("doc_id", "item_id", "quote").distinct()
    return met.join(docs, "doc_id").where(F.contains("body", "quote")).select("doc_id", "item_id")


@query(f"""WITH d AS (SELECT doc_id, {sql_stems('text')} AS s FROM documents), b AS (SELECT item_id, {sql_key_stems('text')} AS k FROM benchmark)
SELECT doc_id, item_id, round(len(list_intersect(k, s)) / len(k), 6) AS share FROM d, b WHERE len(k) > 0 AND len(list_intersect(k, s)) >= 0.6 * len(k)""")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.6 of an item's stems: counted over an equi-join on stems."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(text.stems(F.col("text")))).alias("stem"))
    items = table(spark, sf_dir, "benchmark").select("item_id", text.key_stems(F.col("text")).alias("k"))
    wanted = items.select("item_id", F.size("k").alias("n"), F.explode("k").alias("stem"))
    both = docs.join(wanted, "stem").groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    return both.where(F.col("shared") >= 0.6 * F.col("n")).select("doc_id", "item_id", F.round(F.col("shared") / F.col("n"), 6).alias("share"))


@query(f"""WITH d AS (SELECT doc_id, {sql_stems('text')} AS s FROM documents), b AS (SELECT item_id, list_sort({sql_key_stems('text')}) AS k FROM benchmark),
p AS (SELECT * FROM d, b WHERE len(k) > 0 AND len(list_intersect(k, s)) >= 0.6 * len(k))
SELECT doc_id, item_id FROM p WHERE len(list_filter(range(1, greatest(len(s) - 11, 1) + 1), lambda i: len(list_intersect(k, s[i:i + 11])) >= 0.6 * len(k))) > 0""")
def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an item's stems 0.6 within some run of 12 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.stems(F.col("text")).alias("s"))
    items = table(spark, sf_dir, "benchmark").select("item_id", text.key_stems(F.col("text")).alias("k"))
    return near_pairs(docs, items)


def _density(words: tuple[str, ...], per: int, name: str) -> str:
    w = "regexp_extract_all(lower(text), '[a-z][a-z0-9-]+')"
    return f"round({per} * len(list_filter({w}, lambda x: x IN ({text.quoted(words)}))) / greatest(len({w}), 1), 6) AS {name}"


FUNCTION_WORDS = ("the", "and", "of", "und", "der", "que")


@query(
    "SELECT doc_id, " + _density(FUNCTION_WORDS, 1000, "function_word_density") + ", " + _density(text.MARKETING, 1000, "marketing_claim_density") + ", " + _density(text.TECHNICAL, 1, "technical_term_density")
    + r""", round(least(1.0, (len(regexp_extract_all(lower(text), '\b\d+(?:\.\d+)?\s*(?:%|x|nm|µm|mm|w|kw|mw|kwh|wh|ms|ghz|mhz)\b')) + len(regexp_extract_all(lower(text), 'compared with|outperform|reduced|increased|efficiency|accuracy'))) / 1.0), 6) AS claim_specificity FROM documents"""
)
def text_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.density(t, FUNCTION_WORDS, 1000).alias("function_word_density"), text.density(t, text.MARKETING, 1000).alias("marketing_claim_density"),
        text.density(t, text.TECHNICAL).alias("technical_term_density"), text.claim_specificity(t, F.lit(1)).alias("claim_specificity"),
    )


SAID = ("a field trial of it", "Deployed in the real world", "now an industry standard, says a paper", "a prototype study", "research only", "first clinical trial of a proof-of-concept")


@query(r"""WITH t AS (SELECT event_id, event_type || ': ' || [%s][1 + event_id %% 6] AS s FROM events)
SELECT event_id, CASE WHEN regexp_matches(lower(s), 'mass production|commercially available|large[- ]scale deployment|industry standard') THEN 'mature' WHEN regexp_matches(lower(s), 'real[- ]world|field demonstrat|deployed|deployment|first-in-human') THEN 'adoption'
 WHEN regexp_matches(lower(s), '\bpilot\b|field trial|clinical trial') THEN 'pilot' WHEN regexp_matches(lower(s), 'prototype|proof[- ]of[- ]concept|experimental demonstrat') THEN 'poc' ELSE 'research' END AS stage FROM t""" % text.quoted(SAID))
def stage_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(text.strings(*SAID), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.stage_of(F.concat(F.col("event_type"), F.lit(": "), said)).alias("stage"))


@query(r"""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) >= 50 THEN 'high' ELSE 'low' END AS band
  FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL""")
def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k is not null").select("event_id", "k", F.when(F.col("k") >= 50, "high").otherwise("low").alias("band"))


@query(r"""SELECT doc_id, regexp_extract(text, '(?s)(\{.*\})', 1) AS body FROM (SELECT event_id AS doc_id, 'Answer: ' || props || ' done' AS text FROM events)""")
def json_from_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), text.first_json_object(said).alias("body"))


@query(r"""WITH f AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderdate AS d FROM orders)
SELECT o_orderkey, d::DATE AS read_date FROM f""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order date written in one of five formats and read back."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    written = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MM/dd/yyyy")).when(k == 2, F.date_format(d, "dd.MM.yyyy"))
        .when(k == 3, F.date_format(d, "MMM d, yyyy")).otherwise(F.concat(F.lit("Mon, "), F.date_format(d, "d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_date(written).alias("read_date"))


@query(r"""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS s FROM orders)
SELECT o_orderkey, CASE WHEN s = 'n/a' THEN NULL ELSE try_cast(substr(s || '-01-01', 1, 10) AS DATE) END AS day FROM f""")
def date_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    s = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_prefix(s).alias("day"))


def _rates_sql() -> str:
    rows = ", ".join(f"('{c}', {y}, {r})" for c, own in money.USD_RATES.items() for y, r in own.items())
    return f"""WITH r(currency, y, rate) AS (VALUES {rows}),
o AS (SELECT o_orderkey, floor(o_totalprice) + 0.3::DOUBLE AS amount, year(o_orderdate) + 20 AS y, ['USD', 'EUR', 'GBP', 'RUB', 'XXX'][1 + o_orderkey % 5] AS currency FROM orders),
n AS (SELECT o_orderkey, amount, o.currency, arg_min(rate, abs(r.y - o.y) * 10000 + r.y) AS rate FROM o LEFT JOIN r ON r.currency = o.currency GROUP BY ALL)
SELECT o_orderkey, CASE WHEN currency = 'USD' THEN round(amount / 1000000, 6) ELSE round(amount / rate::DOUBLE / 1000000, 6) END AS usd_m FROM n"""


@query(_rates_sql())
def nearest_rate_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("USD", "EUR", "GBP", "RUB", "XXX")))
    orders = table(spark, sf_dir, "orders")
    currency = F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int"))
    return orders.select("o_orderkey", money.to_usd_m(F.floor("o_totalprice") + F.lit(0.3), currency, F.year("o_orderdate") + 20).alias("usd_m"))


@query(r"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'Acme raises $' || l_linenumber || '.5 million in Series B' WHEN 1 THEN 'Beta secures €' || l_linenumber || ',2bn seed round' WHEN 2 THEN 'Pre-seed: £' || l_linenumber || '00k for Gamma' ELSE 'Delta opens an office' END AS title FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN (l_linenumber + 0.5) * 1e6 WHEN 1 THEN (l_linenumber + 0.2) * 1e9 WHEN 2 THEN l_linenumber * 1e5 END AS amount,
  CASE l_linenumber % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS currency, CASE l_linenumber % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'seed' WHEN 2 THEN 'pre-seed' END AS round_name FROM t""")
def amounts_from_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    s = n.cast("string")
    title = (
        F.when(n % 4 == 0, F.concat(F.lit("Acme raises $"), s, F.lit(".5 million in Series B"))).when(n % 4 == 1, F.concat(F.lit("Beta secures €"), s, F.lit(",2bn seed round")))
        .when(n % 4 == 2, F.concat(F.lit("Pre-seed: £"), s, F.lit("00k for Gamma"))).otherwise("Delta opens an office")
    )
    amount, currency = money.amount_from_title(title)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", amount.alias("amount"), currency.alias("currency"), money.round_from_title(title).alias("round_name"))
