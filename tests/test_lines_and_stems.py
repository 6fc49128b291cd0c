"""Line numbers of text files, stemming of query words and sentences, one-pass softmax, loss logs."""

import numpy as np
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions import porter
from wordloom.operators import search as SR
from wordloom.operators import sentences as SE
from wordloom.operators import train as TR
from wordloom.sources.corpus import read_query_words, read_text_lines


def test_lines_are_numbered_through_files_and_splits(spark, tmp_path):
    want = []
    for name, n in (("a", 700), ("b", 1), ("c", 2500)):
        lines = [f"{name}{i} " + "x" * (i % 90) for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = {r.line_no: r.line for r in read_text_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)


def test_query_words_and_sentences_are_stemmed(spark):
    lines = spark.createDataFrame([(1, "Meetings"), (2, "ponies."), (3, ""), (4, "ab")], "id long, line string")
    got = {r.id: r.word for r in read_query_words(lines, stem=True).collect()}
    assert got == {1: porter.stem("meetings"), 2: porter.stem("ponies"), 4: "ab"}
    model = spark.createDataFrame([(0, porter.stem("meetings"), [3.0, 4.0])], "idx long, word string, vec array<double>")
    text = spark.createDataFrame([(1, "Meetings, meetings here.")], "id long, line string")
    assert SE.encode_sentences(text, model, ["id"], cfg=Config(stem=True)).first().vec == [0.6, 0.8]
    assert SE.encode_sentences(text, model, ["id"], cfg=Config()).first().vec is None


def test_one_pass_gives_predictions_and_normaliser(spark):
    r = np.random.default_rng(1)
    n, h = 37, 5
    mi, mo = r.normal(size=(n, h)) * 3, r.normal(size=(n, h)) * 3
    frame = lambda m: spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], "idx long, vec array<double>")
    qids = spark.createDataFrame([(i,) for i in (0, 5, 5, 36)], "idx long")
    targets = spark.createDataFrame([(0, 3), (5, 7)], "center_idx long, context_idx long")
    e = mi @ mo.T
    p = np.exp(e - e.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for block in (4, 2048):
        got = {(x.qid, x.iid): x.prob for x in SR.softmax(frame(mi), frame(mo), qids, block).collect()}
        assert len(got) == 3 * n and all(abs(got[q, i] - p[q, i]) < 1e-12 for q, i in got)
        top = SR.context_predict(frame(mi), frame(mo), qids, targets, 4, block).collect()
        for q in (0, 5, 36):
            own = sorted((x for x in top if x.qid == q), key=lambda x: x.rank)
            want = [i for i in np.argsort(-e[q]) if i != q][:4]
            assert [x.iid for x in own] == want and [x.rank for x in own] == [1, 2, 3, 4]
            assert all(abs(x.prob - p[q, x.iid]) < 1e-12 for x in own)


def test_a_prediction_reads_the_output_layer_once(spark):
    m = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "idx long, vec array<double>")
    plan = SR.softmax(m, m, m.select("idx"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1


def test_log_lines_round_trip(spark):
    rows = [("a", 0, 200.0), ("a", 1, 50.5), ("b", 0, 3.0), ("b", 1, 1.5), ("b", 2, 0.75)]
    df = spark.createDataFrame(rows, "model string, epoch int, loss double").withColumn("ts", F.lit("2024-01-02 03:04:05.678").cast("timestamp"))
    log = TR.render_loss_log(df)
    assert log.where("model = 'a' and line_no = 1").first().line == "[02-01-2024 03:04:05.678] INFO: Loss 50.500000 (25.3%)"
    parsed = TR.parse_loss_log(log, model_col="model")
    assert sorted(tuple(r) for r in parsed.collect()) == [("a", 0, 200.0, 100.0), ("a", 1, 50.5, 25.3), ("b", 0, 3.0, 100.0), ("b", 1, 1.5, 50.0), ("b", 2, 0.75, 25.0)]
    assert [tuple(r) for r in TR.compare_models(parsed, ["a", "b"]).orderBy("epoch").collect()] == [(0, 100.0, 100.0), (1, 25.3, 50.0), (2, None, 25.0)]
