"""Licence scan against brute force."""

import re

import pytest
from tables import docs, messy

from wordloom.llm import licenses


def grams(text):
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return {(a, b) for a, b in zip(w, w[1:])}


def brute(rows, t):
    out = []
    for doc, text in rows:
        if text is None:
            continue
        lines = text.split("\n")
        blocks = re.split(r"\n[ \t\r]*(?:\n[ \t\r]*)+", text)
        units = [("line", i, x) for i, x in enumerate(lines)]
        units += [("paragraph", i, x) for i, x in enumerate(b for b in blocks if "\n" in b)] if len(lines) > 1 else []
        units += [("text", 0, text)] if len(blocks) > 1 else []
        for unit, i, body in units:
            a, best = grams(body), None
            for name, own in licenses.TEMPLATES.items():
                for b in map(grams, own):
                    d = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                    if d >= t and (best is None or (-d, name) < best):
                        best = (-d, name)
            if best:
                out.append((doc, unit, i, best[1], -best[0]))
    return sorted(out, key=str)


MIT = licenses.TEMPLATES["MIT"][-1]
ROWS = messy() + [(400, "Some prose here.\nReleased under the MIT license!\nmore"), (401, "Copyright (c) 2020 Someone\n\n" + MIT.replace(". ", ".\n") + "\n\nend"), (402, MIT),
                  (403, "license"), (404, "released under"), (405, "Licensed under CC BY-NC 4.0."), (405, "Licensed under CC BY-NC 4.0."), (406, "Licensed under CC BY 4.0"),
                  (None, "Released under the ISC License."), (407, ("pad " * 30_000) + "\nReleased under the zlib License.")]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_matches_brute_force(spark, threshold):
    got = licenses.scan(docs(spark, ROWS), threshold).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS, threshold)


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(docs(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan and "Cartesian" not in plan


def test_empty_table_and_bad_threshold(spark):
    assert licenses.scan(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(docs(spark, ROWS), 0)


def test_paragraphs_inside_other_text(spark):
    rows, want = [], []
    for i, (name, own) in enumerate(licenses.TEXTS.items()):
        for j, text in enumerate(x for x in own if "\n\n" in x):
            parts = ["\n".join(re.findall(r"\S.{0,60}(?:\s|$)", p)) for p in text.split("\n\n")]
            rows.append((10 * i + j, "\n\n".join(["A library for many things.\nIt does them all."] + parts + ["See the manual.\nIt is long."] * 9)))
            want.append((10 * i + j, name))
    got = {}
    for r in licenses.scan(docs(spark, rows)).collect():
        got.setdefault(r["id"], []).append((r["place"], r["license"], r["dice"]))
    assert len(rows) > 10
    for i, name in want:
        assert got.get(i) and all(name in x.split(" OR ") for _, x, d in got[i] if d == 1), (i, name, got.get(i))
        assert any(x == name for _, x, _ in got[i]), (name, got[i])
