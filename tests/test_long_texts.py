"""Long texts: pieces, fragments with halos, and equality with whole rows and plain loops."""

import random
from collections import Counter

from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions import text as T
from wordloom.operators import cooc as CO
from wordloom.operators import tokens as TK

STOPS = ["the", "and"]
WHOLE = 1 << 40


def texts():
    r = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["the", "and", "12", "x", "e.g.", "end.", "now?", "so!\n", "line\n", "cr\r", "d\u2019or", "\u00c0b", "caf\u00e9,"]
    mixed = " ".join(r.choice(words) for _ in range(1500))
    return [(1, mixed), (2, " ".join(r.choice(words[:60]) for _ in range(2000))), (3, "\n".join(r.choice(words) for _ in range(700))), (4, "a" * 900 + " foo bar " + "b" * 500),
            (5, "1 " * 800 + "one two three four five " + "2 " * 800 + "six seven"), (6, ""), (7, None), (8, "short one here. and short two."), (2, mixed[::-1]), (None, mixed[:900])]


def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_pieces_cut_no_token(spark):
    got = docs(spark).where("text is not null").select("text", T.pieces(T.as_lines(T.byte_view(F.col("text"))), 100).alias("p"),
                                                       T.as_lines(T.byte_view(F.col("text"))).alias("t")).collect()
    ends = T.DELIM_BYTES + "\n"
    for r in got:
        assert "".join(r.p) == r.t
        assert all(p[-1] in ends for p in r.p)
        assert all(len(p) <= 100 or not any(c in ends for c in p[:-1]) for p in r.p)


def test_fragments_equal_whole_sentences(spark):
    d = docs(spark)
    whole = TK.sentences(d, Config(), STOPS, piece=WHOLE)
    for size in (64, 333):
        cut = TK.sentences(d, Config(), STOPS, piece=size)
        assert rows(TK.kept_tokens(cut)) == rows(TK.kept_tokens(whole))
        assert rows(CO.cooccurrence_pairs(cut)) == rows(CO.cooccurrence_pairs(whole))
        assert rows(CO.fused_counts(cut)) == rows(CO.fused_counts(whole))
        a = TK.sentence_counts(TK.sentences(d, Config(), STOPS, piece=size, keep_empty=True)).where("n_raw > 0")
        b = TK.sentence_counts(TK.sentences(d, Config(), STOPS, piece=WHOLE, keep_empty=True)).where("n_raw > 0")
        assert rows(a) == rows(b)


def test_raw_tokens_equal_whole_rows(spark):
    d = docs(spark)
    assert rows(TK.raw_tokens(d, piece=100)) == rows(TK.raw_tokens(d, piece=WHOLE))
    assert rows(TK.cleaned_tokens(d, piece=100)) == rows(TK.cleaned_tokens(d, piece=WHOLE))


def test_window_form_by_stretches(spark):
    t = TK.kept_tokens(TK.sentences(docs(spark).where("doc_id <> 2"), Config(), STOPS, piece=WHOLE))
    assert rows(CO.window_self_join(t, stretch=16)) == rows(CO.window_self_join(t))


def test_a_line_of_two_million_words_runs_as_many_tasks(spark):
    r = random.Random(1)
    vocabulary = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    words = [r.choice(vocabulary) for _ in range(2_000_000)]
    d = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    # joins deal by key even where tables are this small, so that the parts' number shows
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        check_two_million(spark, d, words)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def check_two_million(spark, d, words):
    s = TK.sentences(d, Config(), None)
    assert s.count() > 200 and s.agg(F.max(F.size("words"))).first()[0] < 1 << 14
    spread = s.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(spread) >= 4
    want = Counter(words[i] for i in range(len(words)))
    pairs = Counter()
    for dist in range(1, 5):
        pairs.update(Counter(zip(words, words[dist:])))
    both = Counter()
    for (a, b), n in pairs.items():
        if a != b:
            both[min(a, b), max(a, b)] += n
    got = CO.fused_counts(s).collect()
    assert {x.a: x.freq for x in got if x.b is None} == want
    assert {(x.a, x.b): x.freq for x in got if x.b is not None} == both
    assert s.agg(F.max(F.col("start") + F.size("words"))).first()[0] == 2_000_000
