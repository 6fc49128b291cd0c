"""Hot keys: one center / one word holding a third of all rows."""

from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.operators import samples as SM
from wordloom.operators import vocab as VC


def test_hot_center_is_split_evenly(spark):
    # center 0 owns a third of all examples (many contexts, large frequencies)
    hot = [(0, c, 40) for c in range(1, 401)]                  # 16,000 examples
    cold = [(p, (p % 50) + 1, 4) for p in range(1, 8001)]      # 32,000 examples
    targets = spark.createDataFrame(hot + cold, "center_idx long, context_idx long, freq long")
    vocab = spark.createDataFrame([(i, f"w{i:05d}", 1) for i in range(8001)], "idx long, word string, freq long")
    space = SM.slots(vocab, Config(), blocks=4)
    ex, parts, total = SM.example_table(targets, space, 8)
    work = {r.part: r.w for r in ex.groupBy(F.floor(F.col("cell") / 4).alias("part")).agg(F.sum("nrep").alias("w")).collect()}
    assert total == sum(work.values()) == 48000 and len(work) == parts == 8
    assert max(work.values()) <= total / parts + SM.REP_CHUNK
    hot = ex.where("center_idx = 0").select("cell").distinct().count()
    assert hot >= 2                            # the hot center spans several cells
    assert ex.where("cell % 4 <> cblk or center_idx % 4 <> cblk").count() == 0


def test_hot_word_counts_combine_map_side(spark):
    # one word is a third of all tokens
    words = ["hot"] * 5000 + [f"w{i % 997}x" for i in range(10000)]
    sents = spark.createDataFrame([(i, 0, words[i * 50:(i + 1) * 50]) for i in range(300)],
                                  "doc_id long, sid int, words array<string>")
    sents = sents.selectExpr("*", "0 as start", "array() as halo")
    wf = VC.word_freq(sents)
    plan = wf._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert {r.word: r.freq for r in wf.where("word = 'hot'").collect()} == {"hot": 5000}
