"""Money: currencies to millions of US dollars, amounts and rounds from titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Yearly mean rates, units of the currency for one US dollar.
USD_RATES = {
    "EUR": {2015: 0.90, 2016: 0.90, 2017: 0.89, 2018: 0.85, 2019: 0.89, 2020: 0.88, 2021: 0.85, 2022: 0.95, 2023: 0.92, 2024: 0.92, 2025: 0.89, 2026: 0.87},
    "GBP": {2015: 0.65, 2016: 0.74, 2017: 0.78, 2018: 0.75, 2019: 0.78, 2020: 0.78, 2021: 0.73, 2022: 0.81, 2023: 0.80, 2024: 0.78, 2025: 0.76, 2026: 0.75},
    "RUB": {2015: 61.0, 2016: 67.0, 2017: 58.3, 2018: 62.7, 2019: 64.7, 2020: 72.1, 2021: 73.7, 2022: 68.5, 2023: 85.2, 2024: 92.6, 2025: 84.0, 2026: 80.0},
}
# Event kinds and the feature type each counts as (none: kept for audit alone).
KINDS = {
    "grant": "grant", "grant_call": None, "contract": "procurement", "tender": "procurement", "funding_round": "funding",
    "accelerator": "funding", "filing_mention": None, "trial": "trial", "regulation": "regulation",
}


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, y, r) for c, own in USD_RATES.items() for y, r in own.items()], "currency string, year int, rate double")


def to_usd_m(amount: Column, currency: Column, year: Column) -> Column:
    """Millions of dollars at the year's rate, else the nearest known year's (the earlier at a tie); NULL for unknown currencies."""
    value, name = amount.try_cast("double"), F.upper(F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD")))
    out = F.when(name == "USD", F.round(value / 1_000_000, 6))
    for own, by_year in USD_RATES.items():
        known = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(r).alias("r")) for y, r in by_year.items()])
        near = F.array_min(F.transform(known, lambda k: F.struct(F.abs(k["y"] - year).alias("d"), k["y"].alias("y"), k["r"].alias("r"))))["r"]
        out = out.when(name == own, F.round(value / near / 1_000_000, 6))
    return out


def event_type(kind: Column) -> Column:
    """The feature type of an event kind; NULL for unknown kinds."""
    first, *rest = KINDS.items()
    out = F.when(kind == first[0], first[1] or first[0])
    for k, t in rest:
        out = out.when(kind == k, t or k)
    return out


def amount_from_title(title: Column) -> tuple[Column, Column]:
    """Amount and currency of the first sum of money in an English title; NULLs if there is none."""
    pattern = r"(?i)([$€£])\s?(\d+(?:[.,]\d+)?)\s?(bn|billion|b|million|mn|m|k|thousand)?\b"
    sign, number, unit = (F.regexp_extract(title, pattern, k) for k in (1, 2, 3))
    u = F.lower(unit)
    factor = F.when(u.isin("bn", "billion", "b"), 1e9).when(u.isin("million", "mn", "m"), 1e6).when(u.isin("k", "thousand"), 1e3).otherwise(1.0)
    currency = F.when(sign == "$", "USD").when(sign == "€", "EUR").when(sign == "£", "GBP")
    return F.replace(number, F.lit(","), F.lit(".")).try_cast("double") * factor, currency


def round_from_title(title: Column) -> Column:
    """pre-seed, seed, a, b, c or d+; NULL if the title names no round."""
    low = F.lower(title)
    series = F.regexp_extract(low, r"series ([a-z])\b", 1)
    return F.when(low.rlike(r"pre-?seed"), "pre-seed").when(low.rlike(r"\bseed\b"), "seed").when(series.isin("a", "b", "c"), series).when(series > "c", "d+")
