"""N-gram Jaccard join against brute force; connected components against union-find."""

import pytest

import random

import numpy as np

from tables import FOLD, docs, messy, prose, words

from wordloom.llm import jaccard
from wordloom.llm.components import components


def shingle_set(text, n=5):
    w = [x.translate(FOLD) for x in words(text)]
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=80):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), ids.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def near_copies(groups=4, each=25, n=160):
    """Groups of copies with so many changes that similarities lie on both sides of the threshold."""
    r, rows, doc = random.Random(5), [], 1000
    for g in range(groups):
        base = prose(100 + g, n).split()
        for _ in range(each):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"v{r.randint(0, 99)}"
            if r.random() < 0.3:
                del w[:r.randint(1, 20)]
            rows.append((doc, " ".join(w)))
            doc += 1
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = messy() + near_copies() + [(5000 + i, prose(200, 12) + " " + prose(300 + i, 15)) for i in range(30)]
    got = jaccard.groups(docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_blocks_of_lists_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 4)
    rows = near_copies(groups=2)
    got = jaccard.groups(docs(spark, rows).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_keep_one_keeps_columns_and_smallest_ids(spark):
    rows = messy()
    d = docs(spark, rows)
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns
    wanted = {c for doc, _, c in brute(rows) if doc is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(wanted) and ids.count(None) == 2


def test_empty_table(spark):
    assert jaccard.groups(docs(spark, [])).collect() == []


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_keep_one_takes_rows_not_ids(spark):
    a, b, c = (prose(60 + i, 80, 10**6) for i in range(3))
    got = jaccard.keep_one(docs(spark, [(3, a), (3, b), (None, a), (None, c), (None, c), (4, a), (3, b)])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("3", a), ("3", b), ("None", c)])


@pytest.mark.parametrize("diagonal", [True, False])
def test_blocks_of_one_kind_only(spark, diagonal):
    """Batches in which all rows are of one block, or all of pairs of different blocks."""
    sketch = bytes(8 * jaccard.SKETCH_WORDS)
    rows = [(7, 0, 0 if diagonal else 1, 0 if diagonal else half, k, 10, 1, k, bytearray(sketch), [7] + [jaccard.NO_LIST] * (jaccard.LOW_LISTS - 1))
            for k, half in ((1, 0), (2, 0), (3, 1))]
    lists = spark.createDataFrame(rows, "h long, i int, j int, half int, k long, n long, l int, root long, sketch binary, low array<long>")
    want = {(1, 2), (1, 3), (2, 3)} if diagonal else {(1, 3), (2, 3)}
    assert {tuple(r) for r in jaccard._across(lists, 80).collect()} == want


def test_clashing_columns_stay(spark):
    d = docs(spark, messy())
    got = jaccard.keep_one(d)
    assert got.columns == d.columns and {r["_row"] for r in got.collect()} == {"x"}


def test_nearest_pairs_of_each_node():
    a, b, gap = np.array([1, 1, 1, 2, 3]), np.array([2, 3, 4, 3, 4]), np.array([5, 1, 2, 9, 7])
    assert jaccard.nearest_of(a, b, gap, 1).tolist() == [0, 1, 2]
    assert jaccard.nearest_of(a, b, gap, 9).tolist() == [0, 1, 2, 3, 4]
    assert not len(jaccard.nearest_of(a[:0], b[:0], gap[:0], 1))


def test_pairs_of_a_group_grow_with_its_nodes(spark, monkeypatch):
    """Near copies that stars leave apart are joined by few pairs each, not by all pairs across components."""
    r = random.Random(3)
    base = [f"w{r.randint(0, 4000)}" for _ in range(300)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in r.sample(range(300), 3):
            own[at] = f"n{r.randint(0, 10 ** 9)}"
        rows.append((i, " ".join(own)))
    checked, verified = [], jaccard._verified

    def counted(pairs, *more):
        checked.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(jaccard, "_verified", counted)
    got = {x["id"]: x["component_id"] for x in jaccard.groups(docs(spark, rows)).collect()}
    assert set(got.values()) == {0}
    assert sum(checked) <= 12 * len(rows), checked
