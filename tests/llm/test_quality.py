"""Quality rules: statistics and the smoothed model against brute force, junk outside the band."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tables import docs, messy, words

from wordloom.llm import quality


def statistics(t):
    w = words(t)
    c = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    rep = {i + j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed


def test_statistics(spark):
    rows = messy() + [(300, "a b c\nd\n\n a b c\na b c\n|x| <y> #"), (301, "été à à été à à"), (302, "x y z " * 40)]
    got = quality.judge(docs(spark, rows)).collect()
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(((i, *statistics(t)) for i, t in rows), key=str)
    assert all(not (r["base_failed"] and r["kept"]) for r in got)


def brute_model(texts, order):
    fold = lambda t: re.sub(rb"[0-9]", b"0", re.sub(rb"[ \t\n\r\x0b\x0c]", b" ", t.encode()))
    texts = [fold(t) for t in texts]
    raw = Counter()
    for t in texts:
        raw.update(t[i:i + order] for i in range(len(t) - order + 1))
    counts, levels = dict(raw), {}
    for k in range(order, 0, -1):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [0.5 if not (n[1] and n[i]) else min(float(i), max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]
        total, terms = defaultdict(int), {}
        for g, c in counts.items():
            total[g[:-1]] += c
        rest = {}
        for g, c in counts.items():
            terms[g] = max(c - d[min(c, 3) - 1], 0) / total[g[:-1]]
            rest[g[:-1]] = rest.get(g[:-1], 1.0) - terms[g]
        levels[k] = (terms, rest)
        below = Counter()
        for g in counts:
            below[g[1:]] += 1
        counts = dict(below)

    def p(g):
        out = 1 / 256
        for k in range(1, order + 1):
            terms, rest = levels[k]
            out = terms.get(g[-k:], 0.0) + rest.get(g[len(g) - k:-1], 1.0) * out
        return out

    return lambda t: sum(-math.log2(max(1e-12, p(fold(t)[i:i + order]))) for i in range(len(fold(t)) - order + 1)) / (len(fold(t)) - order + 1)


def clean(n, seed):
    r = random.Random(seed)
    parts = ["the", "cat", "sat", "on", "mat", "and", "dog", "ran", "home", "again", "été"]
    return [(i, " ".join(r.choice(parts) + r.choice(["", "s", "ed", "."]) for _ in range(r.randint(60, 150)))) for i in range(n)]


def test_bits_match_brute_force(spark):
    rows = clean(30, 1) + [(100, "ab"), (101, "zq9 " * 60), (102, clean(1, 1)[0][1])]
    d = docs(spark, rows)
    fold = {r["doc_id"]: r["f"] for r in d.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("f")).collect()}
    bits = {f: brute_model([t for i, t in rows if fold[i] != f and not statistics(t)[-1]], quality.ORDER) for f in (0, 1)}
    for size in (quality.MODEL_ROWS, 700):          # in one block, in several
        for r in quality.judge(d, model_rows=size).collect():
            text = dict(rows)[r["id"]]
            if len(text) < quality.ORDER:
                assert r["bits"] is None
            else:
                assert abs(r["bits"] - bits[fold[r["id"]]](text)) < 1e-4


def test_contexts_sum_to_one(spark):
    t = docs(spark, clean(30, 1)).select(F.col("doc_id").alias("id"), "text", F.lit("en").alias("lang"))
    (m,) = quality.models(quality.train(t, 3), 3)
    for history in (b"th", b"at", b"zz", b"  "):
        codes = np.array([(history[0] << 16) | (history[1] << 8) | b for b in range(256)], dtype=np.uint64)
        assert abs((2.0 ** -m.bits(np.full(256, m.known[0]), codes)).sum() - 1) < 1e-4


def test_junk_goes_and_prose_stays(spark):
    r = random.Random(4)
    junk = [(1000 + i, " ".join("".join(r.choice("#$%qxz0&*") for _ in range(6)) for _ in range(80))) for i in range(4)]
    got = {x["id"]: x["kept"] for x in quality.judge(docs(spark, clean(60, 2) + junk)).collect()}
    assert all(got[i] == (i < 1000) for i in got)


def test_languages_without_a_band_and_empty_tables(spark):
    long = " ".join(f"word{i}" for i in range(60))
    got = quality.judge(docs(spark, [(1, "short", "xx"), (2, long, None), (None, long, "yy"), (3, None, None)])).collect()
    assert {(r["id"], r["kept"]) for r in got} == {(1, False), (2, True), (None, True), (3, False)}
    assert quality.judge(docs(spark, [])).collect() == []
