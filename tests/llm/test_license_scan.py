import random
import re

import pytest
from pyspark.sql import functions as F

from fairgate.llm.license_scan import BASE, NOTICES, Template, anchors, license_scan

from .fixtures import docs, edge_rows, empty


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text):
    """Every template at every place, by its bracketed text."""
    words, out = words_of(text), []
    for t in BASE + NOTICES:
        whole, needed, inside = [], [], "[" not in t.text
        for token in t.text.split():
            inside = inside or token.startswith("[")
            whole.append(token.strip("[]"))
            needed.append(inside)
            inside = (inside and not token.endswith("]")) if "[" in t.text else True
        for o in range(-len(whole), len(words)):
            at = lambda j: words[o + j] if 0 <= o + j < len(words) else None  # noqa: E731, B023
            if all(at(j) == w for j, w in enumerate(whole) if needed[j]):
                out.append((t.label, t in BASE, o + needed.index(True), sum(at(j) == w for j, w in enumerate(whole)) / len(whole)))
    return len(words), sorted(out)


def got(df):
    return sorted(((r.doc_id, r.n_words, sorted(tuple(p) for p in r.places)) for r in df.collect()), key=str)


def expected(rows):
    return sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)


def test_templates_say_where_their_phrases_stand():
    t = Template("x", "a [b c] d e [f]")
    assert t.words == list("abcdef") and t.phrases == [(1, ["b", "c"]), (5, ["f"])]
    assert Template("x", "a b").phrases == [(0, ["a", "b"])]
    assert all(words == t.words[at:at + len(words)] for t in BASE + NOTICES for at, words in t.phrases)
    assert [w for w, _ in anchors(t, {"b": 5, "c": 1, "f": 1}, 2)] == ["c", "f"]


def test_equals_every_place_of_every_template(spark):
    rnd = random.Random(3)
    vocabulary = sorted({w for t in BASE + NOTICES for w in t.words}) + ["und", "der"]
    rows = []
    for i in range(200):
        text = []
        for _ in range(rnd.randrange(6)):
            t = rnd.choice(BASE + NOTICES).words
            k = rnd.randrange(len(t)) if rnd.random() < 0.3 else None
            text += [rnd.choice(vocabulary) if j == k else w for j, w in enumerate(t)]
            text += [rnd.choice(vocabulary) for _ in range(rnd.randrange(4))]
        rows.append((i, rnd.choice([" ", "\n", ", ", "-"]).join(w.upper() if rnd.random() < 0.2 else w for w in text), "en", "a"))
    assert sum(len(p) for _, _, p in expected(rows)) > 300
    for n_anchors in (1, 3, 9):                       # the anchors change the work only
        assert got(license_scan(docs(spark, rows), n_anchors=n_anchors)) == expected(rows)


def test_repeated_and_overlapping_places(spark):
    rows = [(1, "CC BY-NC, cc by nc; CC-BY-NC cc by cc by nc", "en", "a"), (2, "apache license version 2" * 2 + " apache license version 2", "en", "a"),
            (3, "under the MIT Licensé under the MİT license under the KMIT license", "en", "a"), (4, "a copy of this software", "en", "a"),
            (5, "general public license gnu general public license", "fr", "b"), (6, "cc by nc " * 20_000, "en", "a")]
    assert got(license_scan(docs(spark, rows[:5]))) == expected(rows[:5])
    (_, n, places), = got(license_scan(docs(spark, rows[5:])))
    assert n == 60_000 and [p[2] for p in places] == list(range(0, 60_000, 3))


def test_edges(spark):
    rows = [r for r in edge_rows() if r[0] != 7] + [(30, "Released under the MIT License.", None, None)] * 3
    assert got(license_scan(docs(spark, rows, extra=True).withColumns({"words": F.lit(1), "hits": F.lit(2)}))) == expected(rows)
    assert license_scan(docs(spark, edge_rows())).count() == len(edge_rows()) and license_scan(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = license_scan(docs(spark, [(1, "x", "en", "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1].replace("REPARTITION", "").split("Scan")[0].replace("Exchange RoundRobin", "")


@pytest.mark.parametrize("label, text", [("gpl", "This work is licensed under the GNU General Public License, version 3."), ("apache-2", "Licensed under the Apache License, Version 2.0."),
                                         ("mit", "Released under the MIT License."), ("cc-by-nc", "Licensed under CC BY-NC 4.0.")])
def test_usual_lines(spark, label, text):
    (_, _, places), = got(license_scan(docs(spark, [(1, text, "en", "a")])))
    assert {p[0] for p in places} == {label}
