"""Language identification: parses against brute force, held-out accuracy, cases without labels."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tables import docs

from wordloom.llm import langid
from wordloom.llm.arrays import text_buffers
from wordloom.llm.frames import read, remainder


def brute_phrases(sample, text, block):
    count = 0
    for lo in range(0, len(text), block):
        part, i = text[lo:lo + block], 0
        while i < len(part):
            n = 1
            if part[i:i + 1] in sample:
                while i + n < len(part) and part[i:i + n + 1] in sample:
                    n += 1
            count += 1
            i += n
    return count


def test_phrases_match_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 17)
    samples = {"a": b"the cat sat on the mat and the dog ate the cat ", "b": b"der hund und die katze sind auf der matte "}
    model = langid.Model(samples)
    texts = ["the dog and the katze", "", "zzz", "auf der mat the cat sat on und the mat on on on", "x" * 100, "cat!! 12 dog"]
    data, offsets = text_buffers(pa.array(texts))
    data, offsets = langid.symbols(data, offsets)
    got = model.phrases(data, offsets)
    for t in range(len(texts)):
        own = data[offsets[t]:offsets[t + 1]].tobytes()
        assert [brute_phrases(samples[x], own, 17) for x in model.names] == got[:, t].astype(int).tolist()


def test_separators_collapse_within_rows():
    data, offsets = text_buffers(pa.array(["a, 1b", "", " é-", "..."]))
    out, at = langid.symbols(data, offsets)
    assert [out[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == ["a b", "", "é ", ""]


def test_held_out_accuracy(spark):
    d = read(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(d, remainder("doc_id", 4) != 2).join(d.select(F.col("doc_id").alias("id"), "lang"), "id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def cases(spark):
    rows = [(i, "the cat sat on the mat with the other cats", "en") for i in range(8)] + [(10 + i, "der hund und die katze liegen auf der matte", "de") for i in range(8)]
    return docs(spark, rows + [(30, None, "en"), (31, "", "de"), (32, "123 !!", "en"), (33, "the mat", None), (None, "die matte der katze", "de"), (33, "the mat", None),
                               (34, "the cat " * 20_000, None)])


def test_cases(spark):
    got = langid.identify(cases(spark), F.lit(True)).collect()
    pred = {}
    for r in got:
        pred.setdefault(r["id"], []).append((r["lang_pred"], r["score"]))
    assert len(got) == 23 and len(pred[33]) == 2
    assert all(pred[i] == [("und", 0.0)] for i in (30, 31, 32))
    assert pred[33][0][0] == "en" and pred[None][0][0] == "de" and pred[34][0][0] == "en"


def test_without_labels_or_rows(spark):
    assert {r["lang_pred"] for r in langid.identify(cases(spark), F.lit(False)).collect()} == {"und"}
    assert langid.identify(docs(spark, []), F.lit(True)).collect() == []


def test_keep_identified(spark):
    d = cases(spark)
    kept = langid.keep_identified(d, F.lit(True))
    assert kept.columns == d.columns
    assert kept.count() == 20 and kept.where("doc_id IN (30, 31, 32)").count() == 0
    only = langid.keep_identified(d, F.lit(True), {"de"}).collect()
    assert len(only) == 9 and {r["lang"] for r in only} == {"de"}


def test_model_of_one_language_has_bits():
    best, first, second, free = langid.Model({"a": b"abc abc "}).parse(pa.array(["abc", None, ""]))
    assert best.tolist() == [0, -1, -1] and first[0] == 1 and np.isinf(second).all() and free[0] == 0


def test_sample_takes_passages_of_whole_texts(spark):
    header = "copyright header of every page "
    rows = [(i, header * 100 + f"ending{'abcdefghijkl'[i]} " * 300, "en") for i in range(12)]
    sample = langid.samples(docs(spark, rows), F.lit(True))["en"]
    assert len(sample) == langid.SAMPLE_CHARS
    assert sum(f"ending{c}".encode() in sample for c in "abcdefghijkl") == 12
    assert 0.3 < sample.count(b"header") * len(header) / len(sample) < 0.8


def test_shared_header_does_not_decide(spark):
    header = "the page header that every document of the source starts with " * 60
    rows = [(i, header + "le chat dort sur le tapis avec les autres chats " * 80, "fr") for i in range(8)]
    rows += [(20 + i, "the cat sat on the mat with the other cats of that house " * 80, "en") for i in range(8)]
    got = {r["id"]: r["lang_pred"] for r in langid.identify(docs(spark, rows + [(50, "les autres chats dort", None), (51, "the other cats sat", None)]), F.lit(True)).collect()}
    assert got[50] == "fr" and got[51] == "en"


def test_every_language_is_learned_in_blocks(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(100 * i + j, f"{a}{b}{a} {b}{b}{a} " * 12, f"{a}{b}") for i, (a, b) in enumerate((a, b) for a in letters for b in letters if a < b) for j in range(2)]
    d = docs(spark, rows)
    whole = {(r["id"], r["lang_pred"], round(r["score"], 9)) for r in langid.identify(d, F.lit(True), sample_chars=256).collect()}
    split = {(r["id"], r["lang_pred"], round(r["score"], 9)) for r in langid.identify(d, F.lit(True), sample_chars=256, total_chars=20_000).collect()}
    assert whole == split and len({x[1] for x in split}) == 190
    assert all(lang == {r[0]: r[2] for r in rows}[i] for i, lang, _ in split)


def test_parse_rejects_unknown_scripts(spark):
    d = docs(spark, [*((i, "the cat sat on the mat with the other cats", "en") for i in range(8)), (20, "кошка сидит на коврике с другими кошками", None), (21, "the mats", None)])
    assert {r["doc_id"] for r in langid.keep_identified(d, F.lit(True)).collect()} == {*range(8), 21}
    assert langid.keep_identified(docs(spark, []), F.lit(True)).collect() == []
    odd = d.withColumnRenamed("source", "_best") if "source" in d.columns else d.withColumn("_best", F.lit(1))
    assert langid.keep_identified(odd, F.lit(True)).columns == odd.columns
