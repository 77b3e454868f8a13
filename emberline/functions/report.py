"""Values for people, and the small parsers behind annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.text import let, tokens


def display_value(name: str, raw: Column) -> Column:
    """Counts without their logarithm, shares in per cent, flags as yes or no."""
    if name.startswith(("stage_", "missing_")) or name.endswith("_flag") or name == "procurement_presence":
        shown = F.when(raw >= 0.5, "yes").otherwise("no")
    elif "_log" in name:
        shown = F.bround(F.expm1(raw), 0).cast("long").cast("string")
    elif name.endswith(("_share", "_hhi")) or "_share_" in name or "_hhi_" in name:
        shown = F.concat(F.bround(raw * 100, 0).cast("long").cast("string"), F.lit("%"))
    else:
        shown = F.regexp_replace(F.call_function("format_number", raw, F.lit("0.00")), r"\.?0+$", "")
    return F.when(raw.isNull(), "no data").otherwise(shown)


def metric_scale(metrics: list[Column]) -> Column:
    """100 where no metric is over 1, 10 where none is over 10, else 1."""
    top = F.greatest(*metrics) if len(metrics) > 1 else metrics[0]
    return F.when(top <= 1, 100).when(top <= 10, 10).otherwise(1)


def rescaled(metric: Column, scale: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), metric * scale))


# The weights of a hypothesis; risk counts against it.
HYPOTHESIS = {"novelty": 0.25, "feasibility": 0.25, "impact": 0.35, "risk": 0.15}


def hypothesis_score(values: dict[str, Column]) -> Column:
    total = sum((w * (100 - values[k] if k == "risk" else values[k]) for k, w in HYPOTHESIS.items()), F.lit(0.0))
    return F.round(total / sum(HYPOTHESIS.values()), 1)


def field(record: Column, name: str) -> Column:
    """A map's value by name, case and punctuation aside; NULL if there is none."""
    plain = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    return F.element_at(F.map_values(F.map_filter(record, lambda k, v: plain(k) == plain(F.lit(name)))), 1)


def best_sentence(sentences: Column, technology: Column, application: Column) -> Column:
    """The sentence whose smaller overlap with technology and application words is greatest; the first at a tie."""
    def overlap(s: Column) -> Column:
        own = tokens(s)
        return F.least(F.size(F.array_intersect(own, technology)), F.size(F.array_intersect(own, application)))

    scored = F.transform(sentences, lambda s, i: F.struct(overlap(s).alias("n"), (-i).alias("i"), s.alias("s")))
    return let(F.array_max(scored), lambda b: F.when(b["n"] > 0, b["s"]))


def money_hits(title: Column, terms: Column) -> Column:
    """How many significant terms a document's words share, plural s and Cyrillic endings aside."""
    word = lambda w: F.when(w.rlike(r"[\x{0400}-\x{04ff}]"), F.substr(w, F.lit(1), F.lit(5))).otherwise(F.regexp_replace(w, "s+$", ""))
    return F.size(F.array_intersect(F.transform(tokens(title), word), F.transform(terms, word)))
