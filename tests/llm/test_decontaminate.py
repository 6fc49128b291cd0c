"""Benchmark decontamination against brute force."""

import hashlib
import re

import pytest
from tables import FOLD, docs, prose

from wordloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


ITEMS = [(1, prose(1, 25)), (2, "Short ITEM, here!"), (3, None), (4, ""), (5, prose(1, 25)), (10, prose(2, 10)), (None, prose(4, 12)), (2, "short item here"), (6, "été déjà")]
ROWS = [(1, prose(50, 30) + " " + prose(1, 25).upper() + "; " + prose(51, 9)), (2, "a short-item HERE too"), (3, None), (4, ""), (5, prose(52, 40)),
        (6, " ".join(prose(1, 25).split()[3:12])), (7, " ".join(prose(1, 25).split()[3:13])), (None, prose(2, 10)), (8, prose(4, 12)),
        (9, prose(53, 20_000, 3000) + " " + prose(2, 10)), (9, "un été déjà passé"), (9, "un été déjà passé")]


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(0, len(w) - n) + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i:i + size]))
                if own:
                    hit |= set(range(i, i + size))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")


@pytest.mark.parametrize("block", [400_000, 9])
def test_matches_brute_force(spark, block):
    got = decontaminate.report(docs(spark, ROWS), bench(spark, ITEMS), block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS, ITEMS)


@pytest.mark.parametrize("block", [400_000, 9])
def test_clean_documents_keep_rows_whole(spark, block):
    d = docs(spark, ROWS)
    got = decontaminate.clean_documents(d, bench(spark, ITEMS), block=block)
    assert got.columns == d.columns
    clean = [t for (doc, t), b in zip(ROWS, [brute([r], ITEMS)[0] for r in ROWS]) if not b[5]]
    assert sorted((r["text"] for r in got.collect()), key=str) == sorted(clean, key=str)


def test_clean_spans(spark):
    got = decontaminate.clean_spans(docs(spark, [(1, "Before ÉTÉ, été déjà after"), (2, "Nothing here")]), bench(spark, ITEMS)).collect()
    assert {r["id"]: r["text"] for r in got} == {1: "before ÉtÉ after", 2: "Nothing here"}


def test_empty_tables(spark):
    assert decontaminate.report(docs(spark, []), bench(spark, ITEMS)).collect() == []
    assert all(not r["contaminated"] for r in decontaminate.report(docs(spark, ROWS), bench(spark, [])).collect())
