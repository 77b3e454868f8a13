"""Licence scans: Dice coefficient over word bigrams against licence templates, pruned by size.

A document is compared line by line, by the sentences of lines that have several, by paragraphs of several lines
(parted by empty lines), if it has several paragraphs as a whole, and by windows: runs of lines, over empty
ones too, that begin and end with a line of which at least half the bigrams are in templates, and that have no
more words than a set of the largest size to be compared has at least. So a licence of many lines or paragraphs
is found inside other text; a statement in the middle of a longer sentence is not. Of the windows, the best for
each licence counts, as one unit. A unit is lower-cased to words of a-z and digits (with dots inside numbers) and
becomes the set of its word bigrams. Two sets of sizes a and b can't reach a Dice coefficient t unless the
smaller is at least t / (2 - t) of the larger, so only templates within these bounds are compared; units that
share no bigram with any template are not compared at all. A unit counts for the template it is most like (at a
tie the first identifier), from `threshold` on.

Templates are a fixed parameter of the operator, not data. Units without a bigram match nothing. Null text
counts as empty, rows without doc_id are left out, repeated rows count once, an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import slim
from emberline.llm.license_templates import templates

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
PARTS = re.compile(r"\n[ \t\r]*\n")
SENTENCES = re.compile(r"[.!?;][ \t\r]+")
THRESHOLD = 0.8


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


class Matcher:
    def __init__(self, texts: list[tuple[str, str]], threshold: float):
        known = sorted(((len(b), k, b) for k, t in texts if (b := bigrams(words_of(t)))), key=lambda x: (x[0], x[1]))
        self.sizes = [n for n, _, _ in known]
        self.known = known
        self.any = set().union(*(b for _, _, b in known)) if known else set()
        self.threshold = threshold
        self.ratio = threshold / (2 - threshold)
        self.least = self.ratio * min(self.sizes, default=0)
        self.most = max(self.sizes, default=0) / self.ratio
        self.most_words = int(self.most + 1e-9) + 1

    def best(self, own: set[tuple[str, str]]) -> tuple[str, float] | None:
        n = len(own)
        if not n or n < self.least or n > self.most or self.any.isdisjoint(own):
            return None
        found = None
        for size, name, b in self.known[bisect_left(self.sizes, self.ratio * n - 1e-9) : bisect_right(self.sizes, n / self.ratio + 1e-9)]:
            dice = 2 * len(own & b) / (n + size)
            if dice >= self.threshold and (found is None or (-dice, name) < (-found[1], found[0])):
                found = (name, dice)
        return found

    def units(self, text: str) -> Iterator[tuple[str, int, str, float]]:
        """Kind, number, licence and Dice coefficient of each unit that matches."""
        line_no = sentence_no = 0
        parts = PARTS.split(text)
        for p, part in enumerate(parts):
            lines = part.split("\n")
            for line in lines:
                own = bigrams(words_of(line))
                if got := self.best(own):
                    yield "line", line_no, *got
                if not self.any.isdisjoint(own) and len(sentences := SENTENCES.split(line)) > 1:
                    for sentence in sentences:
                        if got := self.best(bigrams(words_of(sentence))):
                            yield "sentence", sentence_no, *got
                        sentence_no += 1
                line_no += 1
            line_no += 1
            if len(lines) > 1 and (got := self.best(bigrams(words_of(part)))):
                yield "paragraph", p, *got
        if len(parts) > 1 and (got := self.best(bigrams(words_of(text)))):
            yield "document", 0, *got
        for name, (dice, first) in self.windows(text).items():
            yield "window", first, name, dice

    def windows(self, text: str) -> dict[str, tuple[float, int]]:
        """Dice coefficient and first line of the best window for each licence."""
        lines = [(w, b, 2 * len(b & self.any) >= len(b) > 0) for line in text.split("\n") if (w := words_of(line)) for b in (bigrams(w),)]
        found: dict[str, tuple[float, int]] = {}
        for first, (words, own, anchor) in enumerate(lines):
            if not anchor or len(words) > self.most_words:
                continue
            own, last, n = set(own), words[-1], len(words)
            for more, b, ends in lines[first + 1 : first + self.most_words]:
                n += len(more)
                if n > self.most_words:
                    break
                own |= b
                own.add((last, more[0]))
                last = more[-1]
                if ends and len(own & self.any) + 1e-9 >= self.ratio * len(own) and (got := self.best(own)):
                    name, dice = got
                    if name not in found or dice > found[name][0]:
                        found[name] = (dice, first)
        return found


SCHEMA = "doc_id long, unit string, number long, license string, dice double"


def license_units(docs: DataFrame, threshold: float = THRESHOLD, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, unit, number, license, dice for each line, sentence, paragraph, document or best window that matches."""
    texts = templates() if texts is None else texts

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(texts, threshold)
        for batch in batches:
            rows = [(doc_id, *u) for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True) for u in matcher.units(text.as_py())]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "unit", "number", "license", "dice"])

    return slim(docs).mapInArrow(f, SCHEMA)


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, best_dice, n_units: a row for each licence that a document holds."""
    found = license_units(docs, threshold, texts).distinct()
    return found.groupBy("doc_id", "license").agg(F.round(F.max("dice"), 9).alias("best_dice"), F.count(F.lit(1)).alias("n_units"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB's SQL."""
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in templates())
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:\.[0-9]+)*')"
    most_words = Matcher(templates(), threshold).most_words
    return f"""
WITH t AS (SELECT license, {words.format("txt")} AS w FROM (VALUES {values}) AS v(license, txt)),
tb AS (SELECT license, {grams} AS b FROM t),
ta AS (SELECT DISTINCT unnest(b) AS g FROM tb),
p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS p, len(parts) AS n_parts, text
      FROM (SELECT doc_id, text, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS parts FROM documents)),
u AS (SELECT doc_id, 'line' AS unit, p * 1000000 + generate_subscripts(string_split(part, chr(10)), 1) AS number, unnest(string_split(part, chr(10))) AS s FROM p
      UNION ALL SELECT doc_id, 'paragraph', p, part FROM p WHERE contains(part, chr(10))
      UNION ALL SELECT DISTINCT doc_id, 'document', 0, text FROM p WHERE n_parts > 1),
sp AS (SELECT doc_id, number, regexp_split_to_array(s, '[.!?;][ \\t\\r]+') AS parts FROM u WHERE unit = 'line'),
us AS (SELECT * FROM u UNION ALL
       SELECT doc_id, 'sentence', number * 1000000 + generate_subscripts(parts, 1), unnest(parts) FROM sp WHERE len(parts) > 1),
l AS (SELECT DISTINCT doc_id, n, {words.format("s")} AS w
      FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS s FROM documents)),
lb AS (SELECT *, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM l WHERE len(w) > 0),
la AS (SELECT doc_id, n FROM (SELECT doc_id, n, unnest({grams}) AS g FROM lb) LEFT JOIN ta USING (g) GROUP BY ALL HAVING 2 * count(ta.g) >= count(*)),
f AS (SELECT * FROM lb SEMI JOIN la USING (doc_id, n)),
wn AS (SELECT a.doc_id, a.n AS first, z.n AS last FROM f a JOIN f z ON a.doc_id = z.doc_id AND a.n < z.n AND z.upto - a.upto + len(a.w) <= {most_words}),
ww AS (SELECT doc_id, first, last, flatten(list(lb.w ORDER BY lb.n)) AS w FROM wn JOIN lb USING (doc_id) WHERE lb.n BETWEEN first AND last GROUP BY ALL),
uw AS (SELECT doc_id, unit, number, {words.format("s")} AS w FROM us),
ub AS (SELECT doc_id, unit, number, {grams} AS b FROM uw UNION ALL SELECT doc_id, 'window', first * 1000000 + last, {grams} FROM ww),
m AS (SELECT doc_id, unit, number, license, 2.0 * len(list_intersect(ub.b, tb.b)) / (len(ub.b) + len(tb.b)) AS dice
      FROM ub, tb WHERE len(ub.b) > 0 AND len(ub.b) <= 2 * len(tb.b) AND len(tb.b) <= 2 * len(ub.b)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, number ORDER BY dice DESC, license) AS k FROM m WHERE dice >= {threshold})
SELECT doc_id, license, round(max(dice), 9) AS best_dice, count(*) FILTER (unit <> 'window') + max((unit = 'window')::INT) AS n_units FROM r WHERE k = 1 GROUP BY ALL
"""
