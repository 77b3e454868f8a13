"""Text normalisation and matching as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.columns import let

# Words that widen a phrase without narrowing it, and the word lists of the density features.
GENERIC = (
    "the", "and", "for", "with", "from", "into", "based", "using", "via", "of", "in", "on", "to", "a", "an",
    "technology", "technologies", "system", "systems", "platform", "platforms", "solution", "solutions",
    "management", "approach", "approaches", "application", "applications", "method", "methods",
    "framework", "tool", "tools", "service", "services", "novel", "new", "advanced", "emerging",
    "next-generation", "next", "generation", "early", "stage", "development", "innovative",
)
TERM_STOP = ("ai", "for", "and", "the", "of", "in", "based", "system", "systems", "technology", "technologies", "platform", "solution", "solutions", "application", "applications")
MARKETING = ("revolutionary", "breakthrough", "game-changing", "unprecedented", "transformative", "disruptive")
TECHNICAL = (
    "model", "sensor", "processor", "computing", "learning", "electrochemical", "photonic", "quantum", "robot", "network", "protocol", "algorithm",
    "controller", "semiconductor", "battery", "electrolyte", "actuator", "metamaterial", "microfluidic", "federated",
)
UNIT_NUMBER = r"\b\d+(?:\.\d+)?\s*(?:%|x|nm|µm|mm|w|kw|mw|kwh|wh|ms|ghz|mhz)\b"
CLAIM = r"compared with|outperform|reduced|increased|efficiency|accuracy"
TOKEN = r"[a-z0-9а-яё][a-z0-9а-яё+\-]*"
CYRILLIC = r"[\x{0400}-\x{04ff}]"


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def casefold(text: Column) -> Column:
    """Lower case with ß as ss, which equals full case folding for the scripts handled here."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalized_text(text: Column) -> Column:
    """Folded case, white space collapsed."""
    return F.trim(F.regexp_replace(casefold(text), r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normalized_text(text), 256)


def clean_text(text: Column) -> Column:
    """No NUL or tab, at most two line ends in a row, no space at the ends."""
    spaced = F.regexp_replace(F.translate(text, "\u0000", ""), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def candidate_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(text), r"[^\p{L}\p{N}_]+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def key_tokens(text: Column) -> Column:
    generic = strings(*GENERIC)
    return F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~F.array_contains(generic, t))


def stem(word: Column) -> Column:
    """Cyrillic words by their first five letters; ies, es, s and a last y are cut from long others."""
    n = F.length(word)
    cut = lambda k: F.substr(word, F.lit(1), n - k)
    return (
        F.when(word.rlike(CYRILLIC), F.substr(word, F.lit(1), F.lit(5)))
        .when((n > 6) & word.endswith("ies"), cut(3))
        .when((n > 5) & word.endswith("es"), cut(2))
        .when((n > 4) & word.endswith("s"), cut(1))
        .when((n > 4) & word.endswith("y"), cut(1))
        .otherwise(word)
    )


def stems(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def key_stems(text: Column) -> Column:
    return F.array_distinct(F.transform(key_tokens(text), stem))


def share_present(words: Column, present: Column) -> Column:
    return F.size(F.array_intersect(words, present)) / F.size(words)


def relevant(text_stems: Column, phrase_stems: Column, min_share: float = 0.6) -> Column:
    """A phrase's stems are there in at least min_share; a phrase without stems never is."""
    return (F.size(phrase_stems) > 0) & (F.size(F.array_intersect(phrase_stems, text_stems)) >= min_share * F.size(phrase_stems))


def near(text_stems: Column, phrase_stems: Column, min_share: float = 0.6, window: int = 12) -> Column:
    """relevant() within some run of `window` tokens."""
    runs = F.sequence(F.lit(1), F.greatest(F.size(text_stems) - window + 1, F.lit(1)))
    inside = F.exists(runs, lambda i: F.size(F.array_intersect(phrase_stems, F.slice(text_stems, i, window))) >= min_share * F.size(phrase_stems))
    return relevant(text_stems, phrase_stems, min_share) & inside


def short_phrases(term: Column, max_words: int = 3) -> Column:
    """The first words without generic ones, and of three words also the first and the last two."""
    def phrases(words: Column) -> Column:
        joined = F.array_join(words, " ")
        cores = F.array(joined, F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, -2, 2), " "))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) > 2, F.array_distinct(cores)).otherwise(F.array(joined))

    return F.when(term.rlike(CYRILLIC), F.array().cast("array<string>")).otherwise(let(F.slice(key_tokens(term), 1, max_words), phrases))


def norm_term(term: Column) -> Column:
    """Lower-cased words, the plural s of long ones cut, joined by a space."""
    words = F.regexp_extract_all(F.lower(term), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)), " ")


def technology_words(term: Column) -> Column:
    words = F.regexp_extract_all(casefold(term), F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))
    stop = strings(*TERM_STOP)
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    return F.transform(kept, lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def language_hint(text: Column) -> Column:
    """ru where Cyrillic letters outnumber Latin ones and 20."""
    ru = F.regexp_count(text, F.lit("[А-Яа-яЁё]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(ru > F.greatest(latin, F.lit(20)), "ru").otherwise("unknown")


# Scripts by code point ranges.
SCRIPTS = {
    "latin": "A-Za-zÀ-ÖØ-öø-ÿ",
    "cyrillic": "Ѐ-ӿ",
    "greek": "Ͱ-Ͽ",
    "arabic": "؀-ۿ",
    "hebrew": "֐-׿",
    "han": "一-鿿",
    "kana": "぀-ヿ",
}


def script_count(text: Column, script: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{SCRIPTS[script]}]", ""))


def quote_present(quote: Column, text: Column) -> Column:
    """The quote has 20 characters and stands in the text, both normalised."""
    return (F.length(F.trim(quote)) >= 20) & F.contains(normalized_text(text), normalized_text(quote))


def density(text: Column, words: tuple[str, ...], per: int = 1) -> Column:
    all_words = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9-]+)"), F.lit(1))
    listed = strings(*words)
    return F.round(per * F.size(F.filter(all_words, lambda w: F.array_contains(listed, w))) / F.greatest(F.size(all_words), F.lit(1)), 6)


def claim_specificity(text: Column, n_docs: Column) -> Column:
    low = F.lower(text)
    hits = F.regexp_count(low, F.lit(UNIT_NUMBER)) + F.regexp_count(low, F.lit(CLAIM))
    return F.round(F.least(F.lit(1.0), hits / F.greatest(n_docs, F.lit(1))), 6)


def strip_html(html: Column) -> Column:
    """Tags, scripts, styles and comments out, common entities decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


# Development stages by precedence, and the words that tell them; anything else is research.
STAGES = (
    ("mature", r"mass production|commercially available|large[- ]scale deployment|industry standard"),
    ("adoption", r"real[- ]world|field demonstrat|deployed|deployment|first-in-human"),
    ("pilot", r"\bpilot\b|field trial|clinical trial"),
    ("poc", r"prototype|proof[- ]of[- ]concept|experimental demonstrat"),
)


def stage_of(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda e, s: e.when(low.rlike(s[1]), s[0]), STAGES[1:], F.when(low.rlike(STAGES[0][1]), STAGES[0][0])).otherwise("research")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+", -1), lambda s: F.length(F.trim(s)) > 0)


def first_json_object(text: Column) -> Column:
    """From the first brace to the last, if that is JSON; NULL otherwise."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def clean_phrase(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r"^[ .,;\"']+|[ .,;\"']+$", "")


def money_phrase_ok(phrase: Column) -> Column:
    n = F.size(F.split(phrase, " ", -1))
    return n.between(2, 4) & phrase.rlike(r"^[A-Za-z0-9 +\-/]+$")


def quoted(words: tuple[str, ...]) -> str:
    return ", ".join("'" + re.sub("'", "''", w) + "'" for w in words)
