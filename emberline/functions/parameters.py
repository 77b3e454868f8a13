"""Measured values in text: what a number with a unit measures, groups of them, and labels that are numbers alone."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import let

# Units and what they measure.
REPLACEMENTS = (
    (r"(?i)^рН", "pH"),
    (r"(?i)\bum\b", "мкм"),
    (r"µm|μm", "мкм"),
    (r"(?i)\bmm\b", "мм"),
    (r"(?i)\bkg/t\b", "кг/т"),
    (r"(?i)\bg/t\b", "г/т"),
    (r"(?i)\bt/h\b|\btph\b", "т/ч"),
)
REPLACED = "|".join(f"(?:{pattern})" for pattern, _ in REPLACEMENTS)  # what none of them finds stays as it is
UNITS = "%|г/т|кг/т|g/t|kg/t|мкм|µm|μm|um|мм|mm|т/ч|t/h|tph|ppm|°c|°с|℃"
ACIDITY = "pH|рН"
# What a value measures: parts of a unit, words of which one must stand near (none: any), label; the first that holds.
LABELS = tuple(
    (tuple(units.split("|")), tuple(around.split("|")) if around else (), label)
    for units, around, label in (
        ("ph|рн", "", "pH / кислотность"),
        ("г/т|g/t|кг/т|kg/t", "", "Расход реагента / дозировка"),
        ("мкм|µm|μm|um", "", "Крупность / размер частиц"),
        ("мм|mm", "крупн|частиц|зерн|сито|mesh|particle|size|class", "Крупность / размер частиц"),
        ("мм|mm", "", "Размер / геометрия"),
        ("т/ч|t/h|tph", "", "Производительность / поток"),
        ("ppm", "", "Концентрация / ppm"),
        ("°c|°с|℃", "", "Температура"),
        ("%", "извлеч|recovery|yield|выход", "Извлечение / выход"),
        ("%", "содерж|grade|массов|доля|концентрат", "Содержание / массовая доля"),
        ("%", "влажн|moisture", "Влажность"),
        ("%", "", "Процентный показатель"),
    )
)

NUMBER = r"\p{Nd}+(?:[,.]\p{Nd}+)?(?:\s*[-–—]\s*\p{Nd}+(?:[,.]\p{Nd}+)?)?"  # a value or a range
WORD = r"[\p{L}\p{N}_/]"
MEASURED = rf"(?iu)(?<!{WORD})(?:(?:{ACIDITY})\s*)?{NUMBER}\s?(?:{UNITS})(?!{WORD})|(?<!{WORD})(?:{ACIDITY})\s?{NUMBER}(?!{WORD})"
BARE = rf"(?iu)^\s*(?:[~≈<>≤≥±]\s*)?(?:(?:{ACIDITY})\s*)?{NUMBER}(?:\s?(?:{UNITS}))?\s*$"


def clean_value(value: Column) -> Column:
    """Points for commas, single spaces, units in one spelling."""
    text = F.trim(F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit(","), F.lit(".")), r"\s+", " "))
    return let(text, lambda t: F.when(t.rlike(REPLACED), reduce(lambda v, r: F.regexp_replace(v, *r), REPLACEMENTS, t)).otherwise(t))


def parameter_label(value: Column, context: Column) -> Column:
    """What a value measures, by its unit and, for shares and millimetres, by the words around it; NULL where the unit says nothing."""
    return _label(value, F.lower(context))


def _label(value: Column, near: Column) -> Column:
    return let(F.replace(F.lower(value), F.lit(" "), F.lit("")), lambda v: _by_unit(v, near))


def _by_unit(v: Column, near: Column) -> Column:
    rules = [(v.rlike("|".join(units)) & (near.rlike("|".join(around)) if around else F.lit(True)), label) for units, around, label in LABELS]
    return reduce(lambda chain, rule: chain.when(*rule), rules[1:], F.when(*rules[0]))


def low_signal_label(kind: Column, label: Column) -> Column:
    """A metric, parameter, property, concept or observation whose label is a number or range alone, with a known unit or not."""
    return F.lower(F.trim(kind)).isin("metric", "parameter", "property", "concept", "observation") & clean_value(label).rlike(BARE)


# The same patterns where texts are met by Python: digits, words and spaces as Spark's patterns have them; units are respelled without regard to the case of ASCII letters alone.
_FOUND = re.compile(MEASURED.replace(r"\p{Nd}", r"\d").replace(r"\p{L}\p{N}_", r"\w").replace(r"\s", r"[ \t\n\x0b\f\r]"))
_RESPELLED = tuple((re.compile(pattern.replace(r"\b", r"(?u:\b)"), re.ASCII), unit) for pattern, unit in REPLACEMENTS)
_GAP = re.compile("[ \t\x0b\f\r]+")


def _kept(f: Callable[[str], tuple]) -> Callable[[str], tuple]:
    """f with its last results for short texts at hand: values and sentences come again."""
    again = lru_cache(2**15)(f)
    return lambda text: again(text) if len(text) <= 300 else f(text)


def sentences(text: str) -> list[str]:
    """Sentences with single spaces, empty ones aside: texts are parted at line feeds and at space after the sign of an end."""
    if any(gap in text for gap in ("  ", "\t", "\x0b", "\f", "\r")):
        text = _GAP.sub(" ", text)
    for end in ".!?。;":
        text = text.replace(end + " ", end + "\n")
    return [s for line in text.split("\n") if (s := line.strip(" "))]


@_kept
def _read(raw: str) -> tuple[str, tuple]:
    """clean_value of a value as found in a sentence, and the (words around, label) that its unit may have, in their order."""
    value = raw.replace(",", ".")
    for pattern, unit in _RESPELLED:
        value = pattern.sub(unit, value)
    v = value.lower().replace(" ", "")
    return value, tuple((around, label) for units, around, label in LABELS if any(u in v for u in units))


@_kept
def _named(sentence: str) -> tuple[tuple[str, str], ...]:
    """The labels and values of a sentence in their order, those without a label aside."""
    near, out = sentence.lower(), []
    for raw in _FOUND.findall(sentence):
        value, labels = _read(raw)
        for around, label in labels:
            if not around or any(w in near for w in around):
                out.append((label, value))
                break
    return tuple(out)


def _grouped(text: str, most: int, examples: int, contexts: int, width: int) -> list[tuple[str, int, str, str]]:
    groups: dict[str, tuple[list[str], list[str]]] = {}
    for sentence in sentences(text):
        for label, value in _named(sentence):
            if (own := groups.get(label)) is None:
                groups[label] = [value], [sentence]
                continue
            own[0].append(value)
            if len(own[1]) < contexts and (len(sentence) > width or sentence not in own[1]):
                own[1].append(sentence)
    ranked = sorted([(-len(values), label) for label, (values, _) in groups.items()])[:most]
    return [(label, -less, "|".join(_frequent(groups[label][0])[:examples]), "|".join([s[:width] for s in groups[label][1][:contexts]])) for less, label in ranked]


def _frequent(values: list[str]) -> list[str]:
    if len(values) < 2:
        return values
    counts = dict.fromkeys(values, 0)
    for value in values:
        counts[value] += 1
    return sorted(counts, key=lambda v: (-counts[v], v))


def parameter_groups(docs: DataFrame, most: int = 12, examples: int = 8, contexts: int = 3, width: int = 220) -> DataFrame:
    """doc_id, label, total, examples, contexts: of each document the labels of the most values (ties by label), each with its most frequent values and its first sentences.

    docs: doc_id, text, one row a document; whole texts are read, once. Values are named as clean_value and parameter_label do. A document's values are counted where its row is, so
    nothing is shuffled and memory is that of a batch of texts. A context is a sentence's first `width` characters; a longer
    sentence stands once for each value.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # what is given back is small as well
                some = batch.slice(at, 1000)
                rows = [(i, *g) for i, text in enumerate(some["text"].to_pylist()) if text for g in _grouped(text, most, examples, contexts, width)]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.record_batch([some["doc_id"].take(columns[0]), *columns[1:]], names=["doc_id", "label", "total", "examples", "contexts"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.make_valid_utf8("text").alias("text")).mapInArrow(f, f"doc_id {id_type}, label string, total long, examples string, contexts string")
