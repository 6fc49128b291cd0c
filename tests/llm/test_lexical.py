"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from tables import FOLD, docs, messy, prose

from wordloom.llm import lexical
from wordloom.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def brute(rows, items, k=10):
    held = [(i, terms(t)) for i, t, *_ in rows]
    held = [(i, len(t), Counter(t)) for i, t in held if t]
    n_docs, total = len(held), sum(n for _, n, _ in held)
    dfs = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        asked = set(terms(text))
        for doc, n, words in held:
            score = 0
            for t in asked & words.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * dfs[t] + 1)))
                score += w * ((10**9 * words[t]) // (1000 * words[t] + 8 * (10 + (90 * n * n_docs) // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, item string, key string")


def got(df):
    return sorted((tuple(r) for r in df.select("item", "rank", "id", "score").collect()), key=str)


ITEMS = [(1, prose(1, 12)), (2, "One TWO w1 w2 w3"), (3, None), (4, ""), (5, "nothing-matches_here"), (1, prose(1, 12)), (None, prose(2, 30)),
         (6, "é È x"), (7, " ".join(f"w{i}" for i in range(400))), (8, "averyveryverylongword1 averyveryverylongword2")]


def corpus():
    r = random.Random(5)
    zipf = [f"w{min(int(r.paretovariate(0.6)), 400)}" for _ in range(40_000)]
    many = [(100 + i, " ".join(r.choices(zipf, k=r.randint(1, 60)))) for i in range(400)]
    return messy(30) + many + [(900, "averyveryverylongword1"), (900, "averyveryverylongwork1 é"), (901, "AveryVeryverylongword2")]


@pytest.mark.parametrize("options", [{}, {"segment_rows": 7}, {"block": 40}, {"k": 3, "segment_rows": 25}])
def test_matches_brute_force(spark, options):
    rows = corpus()
    found = lexical.rank(docs(spark, rows).repartition(3), bench(spark, ITEMS), **options)
    assert got(found) == brute(rows, ITEMS, options.get("k", 10))


def test_accumulators_are_limited():
    import numpy as np
    m = np.full(100, 50)
    doc = np.concatenate([np.arange(20), np.arange(100)])
    term = np.repeat([0, 1], [20, 100])
    s = lexical.Segment(np.arange(100), np.ones(100, bool), m, doc, term, np.ones(120, dtype=np.int64), np.array([5000, 3]))
    assert len(s.best(np.array([0, 1]), 10, 0)) == 20
    assert (s.scores > 0).sum() == 20
    assert len(s.best(np.array([0, 1]), 10, 10**11)) == 0


def test_empty_tables(spark):
    assert got(lexical.rank(docs(spark, []), bench(spark, ITEMS))) == []
    assert got(lexical.rank(docs(spark, messy()), bench(spark, []))) == []
    assert got(lexical.rank(docs(spark, [(1, None), (2, "")]), bench(spark, ITEMS))) == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    found = QUERIES["op11_lexical_search"](spark, sf)
    assert found.columns[:4] == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, items)
