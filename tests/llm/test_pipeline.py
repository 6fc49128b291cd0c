"""The pipeline's stages on small tables, and the registration of the queries."""

import re

import __spark_entry__ as E
import corpus_pipeline as P
import duckdb
import pytest

SF1 = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = E.queries()
    for n in range(1, 11):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert "pipeline" in names and [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "best_fit_packing"]


def test_stages_filter_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, SF1).persist()
        assert now.columns == docs.columns and now.schema == docs.schema or set(now.columns) == set(docs.columns)
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    packed = P.STAGES[-1][1](spark, now, SF1)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_substring_dedup", "op4_line_dedup", "op9_decontamination"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF1}/{t}.parquet'")
    got = E.queries()[name](spark, SF1)
    want = con.sql(E.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())
