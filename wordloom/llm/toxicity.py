"""Toxic passages as maximal scoring segments, documents by extreme-value calibration.

* **Token scores.**  Among labelled documents, the documents of each class that
  have a token give its log-odds under a Dirichlet prior (``PRIOR`` plus the
  background's share of ``STRENGTH``) and their variance.  Tokens over ``Z``
  deviations from zero score their log-odds, within ``CAP``; all others ``-DRIFT``.
* **Passages.**  One pass over a document finds every maximal scoring segment
  (Ruzzo and Tompa, 1999).
* **Calibration.**  With ``lambda`` the positive root of ``E[exp(lambda s)] = 1``
  over the clean class's tokens, the best of ``n`` tokens exceeds ``s`` about
  ``K n exp(-lambda s)`` times by chance; ``K`` is fitted to clean documents.  A
  passage is significant if less than ``expected`` such would come by chance, and
  its strength is ``lambda s - ln(K n)``.
* **Documents.**  A logistic curve of the strongest passage and of the sum over
  significant ones, fitted on labelled documents that gave no token scores, turns
  them into a probability.

Labelled rows are a bounded sample: about ``PER_CLASS`` of each class, by id hash;
three quarters give token scores, one quarter the curve.  All documents are
scored, over their whole texts.

Tokens are runs of ASCII letters, digits and non-ASCII characters of the lower-cased
text.  A word that scores nothing itself scores as its first bytes (``BEGINNINGS``).

Defined cases: null, empty and tokenless texts have no passage and score as
such; labels other than 0 and 1 are ignored, an id labelled both ways is toxic;
null ids are scored but not learned from; repeated rows give one row each;
without labels of both classes every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.arrays import FOLD, LETTERS_DIGITS, Words, in_sorted, mix, pieces, signed
from wordloom.llm.frames import arrow_map, hash_share, materialize

PER_CLASS = 20_000
PRIOR, STRENGTH = 0.5, 500.0
Z, CAP, DRIFT = 3.0, 6.0, 0.4
BEGINNINGS = (7, 5)
EXPECTED = 0.05


def beginnings(w: Words, n: int) -> np.ndarray:
    """Hash of the first ``n`` bytes (up to 8) of each word longer than that; 0 for other words."""
    eight = np.ndarray(shape=(max(len(w.data) - 7, 1),), dtype="<u8", buffer=np.ascontiguousarray(w.data), strides=(1,))
    got = eight[w.start] & np.uint64((1 << 8 * n) - 1)
    return np.where(w.end - w.start > n, mix(got ^ np.uint64(0xA24BAED4963EE407 + n)), np.uint64(0))


def segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last exclusive, score)`` in one pass.

    Candidates are kept with the sums before and after them; a new positive
    value merges back to the nearest candidate that begins lower, unless that
    one already ends as high.
    """
    total, out = 0.0, []                                           # [first, last, sum before, sum after]
    for i, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        now = [i, i + 1, before, total]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= now[2]:
                j -= 1
            if j < 0 or out[j][3] >= now[3]:
                out.append(now)
                break
            now = [out[j][0], now[1], out[j][2], now[3]]
            del out[j:]
    return [(a, b, after - before) for a, b, before, after in out]


class Model:
    """Token scores as sorted arrays, the constants of the extreme-value law, and the curve."""

    def __init__(self, h: np.ndarray, score: np.ndarray, rate: float):
        at = np.argsort(h)
        self.h, self.score, self.rate = h[at], score[at], rate
        self.k = 1.0
        self.curve: np.ndarray | None = None

    def token_score(self, h: np.ndarray) -> np.ndarray:
        at = in_sorted(h, self.h)
        return np.where(at >= 0, self.score[at] if len(self.h) else 0.0, 0.0)

    def passages(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, last word exclusive, score) of the maximal segments of a piece's rows."""
        s = self.token_score(w.hash)
        for n in BEGINNINGS:
            s = np.where(s == 0, self.token_score(beginnings(w, n)), s)
        s = np.where(s == 0, -DRIFT, s)
        up = s > 0
        rows, found = [], []
        for r in np.unique(w.row[up]):
            lo, hi = w.first[r], w.first[r + 1]
            own, pos = s[lo:hi], up[lo:hi]
            cut = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))     # runs of one sign act as one value
            sums = np.add.reduceat(own, cut)
            edge = np.append(cut, len(own))
            got = segments(sums.tolist())
            rows += [r] * len(got)
            found += [(edge[a], edge[b], x) for a, b, x in got]
        f = np.array(found, dtype=np.float64).reshape(-1, 3)
        return np.array(rows, dtype=np.int64), f[:, 0].astype(np.int64), f[:, 1].astype(np.int64), f[:, 2]

    def strength(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.rate * score - np.log(self.k * np.maximum(1, n))

    def features(self, w: Words) -> np.ndarray:
        """Per row: a constant, the strongest passage (-10 for none), and the log of the sum of significant ones."""
        row, _, _, score = self.passages(w)
        best, total = np.full(w.piece.rows, -10.0), np.zeros(w.piece.rows)
        if len(row):
            own = np.clip(self.strength(score, w.counts[row]), -10, 50)
            np.maximum.at(best, row, own)
            sure = own > -np.log(EXPECTED)
            np.add.at(total, row[sure], own[sure])
        return np.stack([np.ones(len(best)), best / 10, np.log1p(total)], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.curve is None else 1 / (1 + np.exp(-np.clip(x @ self.curve, -40, 40)))


def token_scores(y1: np.ndarray, y0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Scores of the tokens that ``y1`` of ``n1`` toxic and ``y0`` of ``n0`` clean token mentions name; 0 if insignificant."""
    prior = PRIOR + STRENGTH * (y1 + y0) / max(1, n1 + n0)
    a0 = PRIOR * len(y1) + STRENGTH
    odds = np.log((y1 + prior) / np.maximum(n1 + a0 - y1 - prior, 1e-9)) - np.log((y0 + prior) / np.maximum(n0 + a0 - y0 - prior, 1e-9))
    z = odds / np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
    return np.where(np.abs(z) > Z, np.clip(odds, -CAP, CAP), 0.0)


def growth_rate(score: np.ndarray, p: np.ndarray) -> float:
    """The positive root of ``sum p exp(rate score) = 1``, for scores with a negative mean and a positive value."""
    if not (score > 0).any() or (p * score).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while (p * np.exp(hi * score)).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * score)).sum() < 1 else (lo, mid)
    return hi


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (y - p) - 0.1 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """``(id, text, toxic, fit)``: the bounded labelled sample; ``fit`` marks the documents that give the curve."""
    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic"), learn.alias("learn"))
    own = own.where("learn AND id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    found = dict(own.groupBy("toxic").count().collect())
    share = {c: min(1.0, per_class / max(1, found.get(c, 0))) for c in (0, 1)}
    own = own.where(F.when(F.col("toxic") == 1, hash_share("id", share[1])).otherwise(hash_share("id", share[0]))) \
        .select("id", "toxic", (F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(4)) == 0).alias("fit"))
    t = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"))
    return t.join(F.broadcast(own), "id")


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: int = PER_CLASS) -> Model:
    """The model of the labelled rows that ``learn`` marks."""
    spark = docs.sparkSession
    rows = materialize(sample(docs, labels, learn, id_col, text_col, label_col, per_class), spark, "labelled")

    def mentions(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, out = np.asarray(batch.column(2)), []
        for p in pieces(batch.column(1)):
            w = Words(p, LETTERS_DIGITS, FOLD)
            h = np.concatenate([w.hash, *(beginnings(w, n) for n in BEGINNINGS)])
            row = np.tile(w.row, 1 + len(BEGINNINGS))
            h, row = h[h != 0], row[h != 0]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.ones(len(h), dtype=bool)                     # a token counts once per document
            first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            out.append(np.stack([h[first], toxic[p.lo + row[first]].astype(np.uint64)]))
        h, t = np.concatenate(out, axis=1)
        values, at = np.unique(h, return_inverse=True)
        y1 = np.bincount(at, weights=t.astype(float), minlength=len(values)).astype(np.int64)
        return pa.record_batch([pa.array(signed(values)), pa.array(y1), pa.array(np.bincount(at, minlength=len(values)) - y1)], names=["h", "y1", "y0"])

    counts = materialize(arrow_map(rows.where("NOT fit").select("id", "text", "toxic"), mentions, "h long, y1 long, y0 long")
                         .groupBy("h").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")), spark, "mentions")
    n1, n0 = (int(x or 0) for x in counts.agg(F.sum("y1"), F.sum("y0")).first())
    got = counts.where(F.col("y1") + F.col("y0") >= 3).toArrow()
    h, y1, y0 = (np.asarray(got[c].combine_chunks()).astype(np.int64) for c in ("h", "y1", "y0"))
    score = token_scores(y1, y0, n1, n0)
    live = score != 0
    p = (y0[live] + PRIOR) / max(1.0, n0 + PRIOR * live.sum())
    rate = growth_rate(np.append(score[live], -DRIFT), np.append(p, max(0.0, 1 - p.sum())))
    model = Model(h[live].view(np.uint64), score[live], rate)
    shared = spark.sparkContext.broadcast(model)

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        top, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for p in pieces(batch.column(1)):
            w = Words(p, LETTERS_DIGITS, FOLD)
            row, _, _, s = shared.value.passages(w)
            np.maximum.at(top, p.lo + row, s)
            n[p.lo:p.hi] = w.counts
        return pa.record_batch([pa.array(top), pa.array(n)], names=["top", "n"])

    fit = rows.where("fit").select("id", "text", "toxic")
    clean = arrow_map(fit.where("toxic = 0"), best, "top double, n long")
    least = float(score[score > 0].min()) if (score > 0).any() else 1.0
    law = clean.agg(F.sum((F.col("top") > 0).cast("long")), F.sum(F.col("n") * F.exp(-rate * F.greatest("top", F.lit(least))))).first()
    model.k = max(float(law[0] or 0), 0.5) / max(float(law[1] or 0), 1e-9)
    shared = spark.sparkContext.broadcast(model)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([shared.value.features(Words(p, LETTERS_DIGITS, FOLD)) for p in pieces(batch.column(1))])
        return pa.record_batch([*(pa.array(c) for c in x.T), batch.column(2)], names=["a", "b", "c", "toxic"])

    got = arrow_map(fit, features, "a double, b double, c double, toxic int").toArrow()
    y = np.asarray(got["toxic"].combine_chunks()).astype(float) if got.num_rows else np.zeros(0)
    if len(np.unique(y)) == 2:
        model.curve = fit_curve(np.stack([np.asarray(got[c].combine_chunks()) for c in "abc"], axis=1), y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        out = [m.probability(m.features(Words(p, LETTERS_DIGITS, FOLD))) for p in pieces(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(np.concatenate(out))], names=["id", "score"])

    return arrow_map(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text")), fn,
                     "id long, score double")


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", expected: float = EXPECTED) -> DataFrame:
    """``id, first, last, score, strength`` of every significant passage; ``last`` exclusive, in words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, cols = shared.value, [[], [], [], [], []]
        for p in pieces(batch.column(1)):
            w = Words(p, LETTERS_DIGITS, FOLD)
            row, first, last, s = m.passages(w)
            strength = m.strength(s, w.counts[row])
            for have, more in zip(cols, (p.lo + row, first, last, s, strength)):
                have.append(more[strength > -np.log(expected)])
        row, *rest = (np.concatenate(c) for c in cols)
        return pa.record_batch([batch.column(0).take(pa.array(row)), *(pa.array(x) for x in rest)], names=["id", "first", "last", "score", "strength"])

    return arrow_map(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text")), fn,
                     "id long, first long, last long, score double, strength double")
