"""PII: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Only built-in functions. Spark has no function for all positions of a pattern, but splitting a text at a
pattern gives what lies between the matches: match and gap lengths, summed, are the positions, in code points.

Kinds and what confirms a proposed span: email (the form alone), ip (four parts of at most 255), card (14 to 19
digits, Luhn), phone (+ and 10 to 15 digits), iban (15 to 34 signs, mod 97). A span's score is the kind's
base score, raised where one of the kind's context words stands within `reach` code points before it. Spans of
the first four kinds are always returned, with their score; an iban is returned from a score of 0.5.

The patterns use possessive repeats and start only where a run of their first class starts (or the last match
ended), so that a text of one long run takes linear time and no stack; what they match is what the plain
forms match. Null text counts as empty; rows without doc_id are left out; repeated rows repeat; an empty
table gives an empty result. Spans of different kinds may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import let
from emberline.llm.common import slim

#: Kind, pattern, a sign that every match holds (or None), base score, context words (as a pattern).
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, r"e-?mail|contact|write|correo|courriel"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|address|server|host|login"),
    ("card", r"[0-9](?:[ -]?[0-9])++", None, 0.7, r"card|visa|master|credit|karte|tarjeta|carte|payment"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6, r"phone|call|tel|mobile|fax|llame|appel"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", None, 0.8, r"iban|account|konto|bank|cuenta|compte"),
)
BASE = 4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """The remainder of the account number written as digits (A 10 to Z 35), the first four signs last."""
    line = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        v = F.conv(F.substr(line, i, F.lit(1)), 36, 10).cast("int")
        return F.when(v < 10, rest * 10 + v).otherwise(rest * 100 + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(line)), F.lit(0), add)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return ~m.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(14, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        d = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(d).between(15, 34) & (mod97(d) == 1)
    return F.lit(True)


def _spans(rank: int, text: Column, matches: Column, reach: int) -> Column:
    kind, pattern, _, base, context = KINDS[rank]

    def located(gaps: Column) -> Column:
        # lengths of gap, match, gap, match, ...: their running sums are ends and starts in turn
        ends = F.aggregate(
            F.sequence(F.lit(1), F.size(matches)),
            F.array(F.lit(0)),
            lambda sums, i: F.array_append(F.array_append(sums, F.element_at(sums, -1) + F.length(F.element_at(gaps, i))), F.element_at(sums, -1) + F.length(F.element_at(gaps, i)) + F.length(F.element_at(matches, i))),
        )
        return let(ends, lambda at: F.transform(matches, lambda m, i: F.struct(F.element_at(at, 2 * i + 2).alias("start"), F.element_at(at, 2 * i + 3).alias("end"), m.alias("value"))))

    def scored(x: Column) -> Column:
        before = F.substr(text, F.greatest(x["start"] - reach, F.lit(0)) + 1, F.least(x["start"], F.lit(reach)))
        score = F.when(F.lower(before).rlike(context), F.lit(min(1.0, base + 0.2))).otherwise(F.lit(base))
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), score.alias("score"))

    found = F.filter(let(F.split(text, pattern, -1), located), lambda x: _confirmed(kind, x["value"]))
    kept = F.transform(found, scored)
    if rank >= BASE:
        kept = F.filter(kept, lambda x: x["score"] >= 0.5)
    return kept


def find_pii(docs: DataFrame, reach: int = 40) -> DataFrame:
    """doc_id and spans: an array of (start, rank, kind, end, value, score), by start and kind."""
    text = F.col("text")
    names = [k[0] for k in KINDS]
    none = F.array().cast("array<string>")
    proposed = []
    for kind, pattern, sign, *_ in KINDS:
        all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        proposed.append((F.when(F.contains(text, F.lit(sign)), all_).otherwise(none) if sign else all_).alias(f"m_{kind}"))
    rows = slim(docs).select("doc_id", "text", *proposed)
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string,score:double>>")
    spans = [F.when(F.size(f"m_{k}") == 0, empty).otherwise(_spans(i, text, F.col(f"m_{k}"), reach)) for i, k in enumerate(names)]
    return rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: counts by base kind, base_sha256 and spans; and the spans' scores, in the same order, which context words raise."""
    found = find_pii(docs)
    spans = F.col("spans")

    def count(rank: int) -> Column:
        return F.size(F.filter(spans, lambda x: x["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank][0]}")

    base = _line(F.filter(spans, lambda x: x["rank"] < BASE))
    scores = F.array_join(F.transform(spans, lambda x: F.round(x["score"], 2).cast("string")), ",").alias("scores")
    return found.select("doc_id", *map(count, range(BASE)), F.sha2(base, 256).alias("base_sha256"), _line(spans).alias("spans"), scores)
