"""Small tables with the cases every operator must stand: nulls, empty and long texts, copies, clashing columns."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns with names that operators use inside
    *(T.StructField(c, T.StringType()) for c in ("id", "h", "k", "row", "key", "first", "size", "learned", "_key", "words", "hits", "_row", "_gone", "_kept"))])


def words(text):
    return WORD.findall(text or "")


def docs(spark, rows):
    """``rows``: (doc_id, text) or (doc_id, text, lang)."""
    full = []
    for r in rows:
        i, text, lang = (*r, "en")[:3]
        full.append((i, text, lang, "s", len(text or ""), *["x"] * 14))
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, vocabulary)}" for _ in range(n))


def messy(copies=3):
    """Unrelated texts, copies, near copies, shared passages, odd spaces, empty and null ones, one very long."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split()
    near[60] = "other"
    rows = [(1, base), (2, " ".join(near)), (3, prose(3, 80)), (4, prose(4, 30) + "\n" + passage + "\n" + prose(5, 40)),
            (5, prose(6, 50) + "\t" + passage.replace(" ", "  ", 3) + " " + prose(7, 20)), (6, ""), (7, None), (8, " \n\t "), (9, "one"),
            (10, "One"), (11, "a b c d"), (12, "A b c d"), (13, "é È x y z"), (14, prose(8, 34)), (15, prose(8, 34)),
            (16, " ".join(["same"] * 200)), (17, prose(9, 30_000, 5000)), (None, prose(10, 90)), (None, None)]
    return rows + [(20 + i, base.upper() if i == 0 else base) for i in range(copies)] + [(3, prose(3, 80))]
