"""Line dedup against brute force; bit-parallel distance against dynamic programming."""

import random

import pytest
from pyspark.sql import functions as F
from tables import docs, messy

from wordloom.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        kind, at = r.choice("sid"), r.randrange(len(s))
        if kind == "s":
            s[at] = r.choice("abcé")
        elif kind == "i":
            s.insert(at, r.choice("abcé"))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_distance_within_band(spark, tau):
    r = random.Random(tau)
    pairs = []
    for _ in range(150):
        a = "".join(r.choice("abé") for _ in range(r.randint(1, 40)))
        pairs.append((a, edited(r, a, r.randint(0, tau + 2))))
    got = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", lines.within(F.split("a", ""), F.split("b", ""), tau).alias("d")).collect()
    for x in got:
        d = distance(x["a"], x["b"]) if x["a"] and x["b"] else None
        if d is not None:
            assert x["d"] == (d if d <= tau else None), x


def brute(rows, tau=2, least=20):
    first = {}
    places = []
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.strip(" ")
            if len(line) >= least:
                key = (doc is not None, doc or 0, no)
                places.append((key, doc, no, line))
                if line not in first or key < first[line]:
                    first[line] = key
    texts = list(first)
    out = set()
    for key, doc, no, line in places:
        near = [(first[t], distance(t, line)) for t in texts if t != line and abs(len(t) - len(line)) <= tau and first[t] < first[line] and distance(t, line) <= tau]
        if near:
            of, d = min(near)
        elif key != first[line]:
            of, d = first[line], 0
        else:
            continue
        out.add((doc, no, of[1] if of[0] else None, of[2], d))
    return out


def lined():
    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(18, 50))).strip() + "." for _ in range(25)]
    rows = []
    for i in range(60):
        picked = [edited(r, r.choice(base), r.choice([0, 0, 1, 2, 3, 4])) for _ in range(r.randint(0, 4))] + ["short", ""]
        rows.append((i, "\n".join(picked)))
    return rows + [(None, base[0]), (100, None), (101, ""), (102, "  " + base[1] + " "), (103, "x" * 20_000)]


def test_matches_brute_force(spark):
    rows = lined()
    got = lines.report(docs(spark, rows)).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_remove_lines(spark):
    rows = lined() + [r for r in messy() if r[0] is not None and r[0] > 200]
    d = docs(spark, rows)
    got = lines.remove_lines(d)
    assert got.columns == d.columns
    gone = {}
    for doc, no, *_ in brute(rows):
        gone.setdefault(doc, set()).add(no)
    want = []
    for doc, text in rows:
        if doc in gone:
            left = [x for no, x in enumerate(text.split("\n")) if no not in gone[doc]]
            if any(x.strip() for x in left):
                want.append((doc, "\n".join(left), len("\n".join(left))))
        else:
            want.append((doc, text, len(text or "")))
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty_table_and_bad_parameters(spark):
    assert lines.report(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        lines.duplicates(docs(spark, []), tau=2, least=3)


def test_rows_without_or_with_one_id_are_documents_of_their_own(spark):
    line, clean = "the quick brown fox jumps over it", "kappa lambda mu nu xi omicron pi rho\none two three four five six seven"
    rows = [(None, line + "\nalpha beta gamma delta epsilon zeta"), (None, clean), (None, line + "\nsigma tau upsilon phi chi psi omega"),
            (7, line), (7, "other words that nobody else has here")]
    got = lines.remove_lines(docs(spark, rows)).collect()
    assert sorted(r["text"] for r in got) == sorted([rows[0][1], clean, "sigma tau upsilon phi chi psi omega", rows[4][1]])
    assert sorted(tuple(r)[:4] for r in lines.report(docs(spark, rows)).collect() if r["id"]) == [(7, 0, None, 0)]
