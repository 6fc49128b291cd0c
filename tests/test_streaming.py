"""Streaming ingestion gives the batch counts."""

import os

from wordloom.config import Config
from wordloom.operators import cooc as CO
from wordloom.operators import tokens as TK
from wordloom.operators import vocab as VC
from wordloom.session import scratch_path
from wordloom.sources.tables import table
from wordloom.streaming import ingest

SF1 = "/root/testdata/sf0.001"


def test_stream_counts_equal_batch(spark):
    src = scratch_path(spark, "stream-src")
    docs = table(spark, SF1, "documents").select("doc_id", "text")
    docs.repartition(4).write.parquet(src)          # four files arrive
    out, chk = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-chk")
    q = ingest.start_count_ingest(ingest.read_documents_stream(spark, src, max_files=1), out, chk,
                                  available_now=True)
    q.awaitTermination(300)
    wf_stream = ingest.word_freq_from_counts(spark, out)
    s = TK.sentences(docs, Config(), None)
    wf = VC.word_freq(s)
    assert wf_stream.exceptAll(wf).count() == 0 and wf.exceptAll(wf_stream).count() == 0
    pc = ingest.pair_counts_from_counts(spark, out)
    und = CO.undirected_counts(s)
    assert pc.exceptAll(und).count() == 0 and und.exceptAll(pc).count() == 0


def test_replayed_batch_is_not_counted_twice(spark):
    docs = table(spark, SF1, "documents").select("doc_id", "text").where("doc_id < 50")
    out = scratch_path(spark, "stream-replay")
    ingest.write_batch_counts(docs, 0, out)
    ingest.write_batch_counts(docs, 0, out)          # the same batch again after a failure
    once = VC.word_freq(TK.sentences(docs, Config(), None))
    got = ingest.word_freq_from_counts(spark, out)
    assert got.exceptAll(once).count() == 0 and once.exceptAll(got).count() == 0
