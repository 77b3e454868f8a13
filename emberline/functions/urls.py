"""URL normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ("fbclid", "gclid")


def canonical_url(url: Column) -> Column:
    """http(s) only, no credentials, ports 80 and 443 alone, no tracking parameters or fragment; NULL where not so."""
    u = F.trim(url)
    part = lambda name: F.try_parse_url(u, F.lit(name))
    scheme, host, netloc = F.lower(part("PROTOCOL")), part("HOST"), F.lower(part("AUTHORITY"))
    port = F.regexp_extract(netloc, r":(\d*)$", 1)
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    pairs = F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&", -1), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING))
    query = F.array_join(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    path = F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    ok = scheme.isin("http", "https") & (F.coalesce(host, F.lit("")) != "") & ~F.contains(netloc, F.lit("@")) & port.isin("", "80", "443")
    return F.when(ok, F.concat(scheme, F.lit("://"), netloc, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def host_of(url: Column) -> Column:
    """Lower-case host without www."""
    value = F.lower(F.trim(url))
    host = F.when(F.contains(value, F.lit("://")), F.coalesce(F.try_parse_url(value, F.lit("HOST")), F.lit(""))).otherwise(F.substring_index(value, "/", 1))
    return F.regexp_replace(host, r"^www\.", "")


def url_key(url: Column) -> Column:
    """Scheme, host without www, path without a last slash, query."""
    u = F.trim(url)
    part = lambda name: F.coalesce(F.try_parse_url(u, F.lit(name)), F.lit(""))
    query = part("QUERY")
    return F.concat(F.lower(part("PROTOCOL")), F.lit("://"), F.regexp_replace(F.lower(part("HOST")), r"^www\.", ""), F.regexp_replace(part("PATH"), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def valid_domain(domain: Column) -> Column:
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return (F.length(domain) <= 253) & domain.rlike(rf"^(?:{label}\.)+{label}$")
