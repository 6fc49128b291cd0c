"""Driver contract and a DuckDB oracle sweep on sf0.001."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E

SF1 = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["idx", "word", "freq"]


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    hs = sorted(hashlib.md5("|".join(_norm(r[i]) for i in order).encode()).hexdigest() for r in rows)
    return hashlib.md5("".join(hs).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF1}/{t}.parquet'")
    return c


FAST = ["read_corpus", "tokenize", "word_clean", "kept_tokens", "word_freq", "filter_high", "vocab_filter",
        "vocab_index", "freq_distribution", "rank_frequency", "cooccurrence_counts", "vocab_targets",
        "query_skip", "similar_words", "context_predict", "similar_sentences", "unigram_draw",
        "tdnd_resample", "sgns_loss", "encode_sentences", "encode_questions", "histogram", "discrete_normal_pmf"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_matches(spark, con, name):
    df = E.queries()[name](spark, SF1)
    rows = [tuple(r) for r in df.collect()]
    r = con.sql(E.oracle_sql()[name])
    orows = r.fetchall()
    assert sorted(df.columns) == sorted(r.columns)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(r.columns, orows)
