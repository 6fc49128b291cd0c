"""Hash-seeded initialisation equals an independent hashlib computation."""

import hashlib
import math

from wordloom.config import Config
from wordloom.operators.model import init_weights


def _reference(idx, stream="ih", seed=0, hidden=50, v=300):
    u = []
    for g in range((hidden + 4) // 5):
        d = hashlib.sha256(f"{seed}:{stream}:{idx}:{g}".encode()).hexdigest()
        u.extend(int(d[12 * s:12 * s + 12], 16) / 2.0 ** 48 for s in range(5))
    scale = math.sqrt(2.0 / (v + v))
    return [(x * 2.0 - 1.0) * scale for x in u[:hidden]]


def test_init_matches_hashlib(spark):
    vocab = spark.createDataFrame([(i, f"w{i}") for i in range(300)], "idx long, word string")
    mi, mo = init_weights(vocab, Config(), 300)
    for r in mi.collect():
        assert r.vec == _reference(r.idx)
    for r in mo.where("idx < 20").collect():
        assert r.vec == _reference(r.idx, "ho")
