"""Substring dedup against brute force."""

import hashlib
from collections import Counter

import pytest
from tables import docs, messy, prose, words

from wordloom.llm import substrings


def brute(rows, n):
    texts = [words(t) for _, t in rows]
    windows = Counter(tuple(w[i:i + n]) for w in texts for i in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = {j for s in range(len(w) - n + 1) if windows[tuple(w[s:s + n])] > 1 for j in range(s, s + n)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,k,group", [(35, 10, 4096), (35, 10, 2), (6, 6, 3), (5, 1, 1)])
def test_matches_brute_force(spark, n, k, group):
    rows = [r for r in messy() if r[0] is not None]
    got = substrings.remove_repeats(docs(spark, rows), n, k, group).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, n)


def test_null_id_is_an_id(spark):
    rows = messy()
    got = substrings.remove_repeats(docs(spark, rows), with_text=False).collect()
    assert len(got) == len(rows) and sum(r["id"] is None for r in got) == 2


def test_empty_table(spark):
    assert substrings.remove_repeats(docs(spark, [])).collect() == []


def test_prefix_must_fit(spark):
    with pytest.raises(ValueError):
        substrings.repeats(docs(spark, []), n=5, k=6)


def test_rows_without_or_with_one_id_are_documents_of_their_own(spark):
    passage = prose(50, 40, 10**6)
    rows = [(None, passage + " " + prose(51, 30, 10**6)), (None, prose(52, 90, 10**6)), (None, prose(53, 20, 10**6) + " " + passage), (7, passage),
            (7, prose(54, 70, 10**6))]
    got = substrings.remove_repeats(docs(spark, rows)).collect()
    assert sorted((str(r["id"]), r["n_words"], r["n_removed"]) for r in got) == [
        ("7", 40, 40), ("7", 70, 0), ("None", 60, 40), ("None", 70, 40), ("None", 90, 0)]
