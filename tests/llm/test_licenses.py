from emberline.llm import licenses
from emberline.llm.license_templates import TEXTS, templates

SCHEMA = "doc_id long, text string, license string, unit string"


def best_of(own, known):
    return min(((-2 * len(own & b) / (len(own) + len(b)), k) for k, b in known if b and own), default=(0, ""))


def plain(text, threshold):
    """Every unit and every window against every template, without pruning."""
    text, hits = text or "", {}
    parts = licenses.PARTS.split(text)
    lines = [x for p in parts for x in p.split("\n")]
    units = lines + [x for y in lines if len(licenses.SENTENCES.split(y)) > 1 for x in licenses.SENTENCES.split(y)]
    units += [p for p in parts if "\n" in p] + ([text] if len(parts) > 1 else [])
    known = [(k, licenses.bigrams(licenses.words_of(t))) for k, t in templates()]
    for u in units:
        best = best_of(licenses.bigrams(licenses.words_of(u)), known)
        if -best[0] >= threshold:
            n, d = hits.get(best[1], (0, 0))
            hits[best[1]] = (n + 1, max(d, -best[0]))
    grams, most = set().union(*(b for _, b in known)), licenses.Matcher(templates(), threshold).most_words
    lines, windows = [w for x in text.split("\n") if (w := licenses.words_of(x))], {}
    anchors = [i for i, w in enumerate(lines) if (b := licenses.bigrams(w)) and 2 * len(b & grams) >= len(b)]
    for i in anchors:
        for j in anchors:
            words = [w for line in lines[i : j + 1] for w in line]
            if i < j and len(words) <= most and -(best := best_of(licenses.bigrams(words), known))[0] >= threshold:
                windows[best[1]] = max(windows.get(best[1], 0), -best[0])
    for k, d in windows.items():
        n, old = hits.get(k, (0, 0))
        hits[k] = (n + 1, max(old, d))
    return {k: (n, round(d, 9)) for k, (n, d) in hits.items()}


def test_against_every_template(spark):
    mit = TEXTS["MIT"]
    split = mit.replace(". ", ".\n")
    rows = [(1, None), (2, ""), (3, "prose\nReleased under the MIT License.\nmore prose"), (4, mit), (5, "intro line\n\n" + split + "\n\nend of it"), (6, TEXTS["BSD-3-Clause"].upper())]
    rows += [(7, TEXTS["BSD-2-Clause"].replace("holder", "owner")), (8, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0\nlicensed  under the apache license version 2.0"), (9, "license " * 50_000), (10, mit[: len(mit) // 2])]
    prose = "\n\n".join(f"The parser of part {i} reads its rows in order and then says how many there were." for i in range(60))
    bsd = TEXTS["BSD-3-Clause"].replace(". ", ".\n\n")
    rows += [(11, prose + "\n\n" + mit.replace(". ", ".\n\n") + "\n\n" + prose), (12, "code = 1\n" + "\n".join("// " + x for x in bsd.split("\n")) + "\nmore = 2\n" + prose)]
    rows += [(13, "Two notes. Released under the MIT License. And a third, longer note about other things.\n" + prose), (14, "the software\n\n" * 40)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows] + [(3, rows[2][1], "clash", "clash"), (None, mit, None, None)], SCHEMA)
    got = {}
    for r in licenses.license_scan(docs).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = (r["n_units"], r["best_dice"])
    assert got == {i: w for i, t in rows if (w := plain(t, licenses.THRESHOLD))}
    assert set(got[5]) == {"MIT"} and set(got[6]) == {"BSD-3-Clause"} and set(got[8]) == {"CC-BY-NC-4.0", "CC-BY-4.0", "Apache-2.0"} and 10 not in got
    assert set(got[11]) == {"MIT"} and set(got[12]) == {"BSD-3-Clause"} and set(got[13]) == {"MIT"}


def test_thresholds_and_own_templates(spark):
    docs = spark.createDataFrame([(1, "a b c d", None, None), (2, "a b c x", None, None)], SCHEMA)
    got = {(r["doc_id"], r["license"], r["best_dice"]) for r in licenses.license_scan(docs, 0.6, [("own", "a b c d")]).collect()}
    assert got == {(1, "own", 1.0), (2, "own", round(4 / 6, 9))}
    assert licenses.license_scan(docs, 0.6, []).count() == 0


def test_empty_table(spark):
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_anchor_lines():
    matcher = licenses.Matcher(templates(), licenses.THRESHOLD)
    assert list(matcher.units("the software\n\n" * 2000)) == []
    assert {u[2] for u in matcher.units("the software\n\n" * 500 + TEXTS["ISC"].replace(". ", ".\n"))} == {"ISC"}
