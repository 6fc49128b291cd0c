"""Tokeniser quirks (fixture F1) and the text expressions."""

from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.operators import cooc as CO
from wordloom.operators import tokens as TK
from wordloom.operators import vocab as VC

F1 = ("The quick fox saw the lazy dog. Lazy dog (don't ask) e.g. sleeps\n"
      "The fox, well-known as R2D2, ran.\n"
      "Àfox café—dog foo’s bar\n")
STOPS = ["the", "don"]


def _sents(spark, text=F1):
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return TK.sentences(docs, Config(), STOPS)


def test_f1_sentences(spark):
    rows = _sents(spark).orderBy("sid").collect()
    assert [r.words for r in rows] == [["quick", "fox", "saw", "lazy", "dog"], ["lazy", "dog", "ask"],
                                      ["sleeps"], ["fox", "well-known"], ["fox", "foo", "bar"]]


def test_f1_word_freq(spark):
    wf = {r.word: r.freq for r in VC.word_freq(_sents(spark)).collect()}
    assert wf == {"ask": 1, "bar": 1, "dog": 2, "foo": 1, "fox": 3, "lazy": 2, "quick": 1, "saw": 1,
                  "sleeps": 1, "well-known": 1}


def test_f1_pairs_and_counts(spark):
    s = _sents(spark)
    und = CO.undirected_counts(s)
    assert CO.pair_count(und).first()[0] == 17
    counts = {(r.center, r.context): r.freq for r in CO.mirror(und).collect()}
    assert len(counts) == 32
    assert counts[("dog", "lazy")] == 2 and counts[("lazy", "dog")] == 2
    assert counts[("quick", "dog")] == 1          # distance 4 is inside the window
    assert all(v == 1 for k, v in counts.items() if k not in {("dog", "lazy"), ("lazy", "dog")})


def test_window_form_equals_in_row(spark, docs1):
    s = TK.sentences(docs1, Config(), None)
    a = CO.cooccurrence_pairs(s).select("doc_id", "sid", "pos", "dist", "center", "context")
    b = CO.window_self_join(TK.kept_tokens(s)).select("doc_id", "sid", "pos", "dist", "center", "context")
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_line_end_token_is_dropped_but_ends_sentence(spark):
    rows = _sents(spark, "alpha beta ran.\ngamma delta").orderBy("sid").collect()
    assert [r.words for r in rows] == [["alpha", "beta"], ["gamma", "delta"]]


def test_strip_all_option(spark):
    docs = spark.createDataFrame([(0, "what?! now")], "doc_id long, text string")
    one = TK.sentences(docs, Config(), None).collect()
    allx = TK.sentences(docs, Config(strip_all=True), None).collect()
    assert [r.words for r in one] == [["now"]]
    assert [r.words for r in allx] == [["what"], ["now"]]


def test_raw_tokens_keep_newline(spark):
    docs = spark.createDataFrame([(0, "a b.\nc")], "doc_id long, text string")
    toks = [r.token for r in TK.raw_tokens(docs).orderBy("pos").collect()]
    assert toks == ["a", "b.\n", "c\n"]


def test_qa_expressions(spark):
    from wordloom.operators import qa as QA
    df = spark.createDataFrame([(0, "Sooo, WHAT's thisss? =~=~> It isss Foo-bar! | ok")], "id long, line string")
    c = QA.clean_qa_lines(df).first().line
    assert c == "soo whats thiss =~=~> it iss foobar | ok"
    s = QA.split_qa(QA.clean_qa_lines(df)).first()
    assert s.question == "soo whats thiss" and s.answer == "it iss foobar | ok"
