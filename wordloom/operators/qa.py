"""The question/answer encoding pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.functions import text as T


def clean_qa_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """T9 + T10: lowercase, delete foreign characters, collapse letter runs."""
    return lines.withColumn(col, T.collapse_letter_runs(T.qa_clean(F.col(col))))


def split_qa(lines: DataFrame, col: str = "line") -> DataFrame:
    """(…, question, answer); lines without the separator are dropped."""
    has_q = F.col(col).rlike("^.* =~=~>")
    has_a = F.col(col).rlike("=~=~>")
    return lines.where(has_q & has_a).withColumn("question", T.split_question(F.col(col))) \
        .withColumn("answer", T.split_answer(F.col(col))).drop(col)


def encode_questions(qa: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Q12: Σ vectors of whitespace tokens found in the vocabulary; rows whose sum
    is all-zero are dropped; the rest L2-normalised; the answer stays attached."""
    from wordloom.operators.sentences import encode_words
    rows = qa.select(*keys, T.whitespace_tokens(F.col("question")).alias("words"))
    enc = encode_words(rows, model, keys, drop_zero=True)
    return qa.join(enc, keys).select(*keys, "question", "answer", "vec")


def qa_encoded_lines(enc: DataFrame, keys: list[str]) -> DataFrame:
    """S11 text form: ``question [v0, v1, …] =~=~> answer``, numbers with six decimals and no exponent."""
    vec = F.concat(F.lit("["), F.concat_ws(", ", F.transform("vec", lambda x: F.format_string("%.6f", F.round(x, 6) + 0.0))), F.lit("]"))
    return enc.select(*keys, F.concat_ws(" ", F.trim(F.col("question")), vec, F.lit("=~=~>"),
                                         F.trim(F.col("answer"))).alias("line"))


def zip_vocab_weights(vocab: DataFrame, weights: DataFrame) -> DataFrame:
    """Vocabulary row i ↔ weight row i (inner join on the row index: shorter side wins)."""
    return vocab.select("idx", "word").join(weights.select("idx", "vec"), "idx")


def export_bundle(encoded: DataFrame, vocab: DataFrame, model_in: DataFrame, path: str,
                  compression: str = "zstd") -> str:
    """Encoded corpus, vocabulary and embeddings written together, compressed."""
    encoded.write.mode("overwrite").option("compression", compression).parquet(f"{path}/corpus_enc")
    vocab.write.mode("overwrite").option("compression", compression).parquet(f"{path}/vocab")
    model_in.write.mode("overwrite").option("compression", compression).parquet(f"{path}/embed")
    return path


def qa_corpus(qa: DataFrame, keys: list[str]) -> DataFrame:
    """Questions as a training corpus (doc_id, text) for the vocabulary build."""
    return qa.select(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("doc_id"),
                     F.col("question").alias("text"), *keys)


def qa_pipeline(conv: DataFrame, cfg: Config = Config(), stops: list[str] | None = None,
                epochs: int = 0, bundle_path: str | None = None):
    """Conversations → Q/A lines → clean → split → vocabulary on questions →
    (train) → encode questions → optional bundle.  Returns (encoded, vocab, model_in)."""
    from wordloom.operators.model import init_weights, normalize_rows
    from wordloom.plans.pipeline import build_vocabulary
    from wordloom.sources.corpus import conversation_qa_lines
    keys = ["conv_id", "turn"]
    qa = split_qa(clean_qa_lines(conversation_qa_lines(conv)))
    docs = qa_corpus(qa, keys)
    vb = build_vocabulary(docs, cfg, stops, with_targets=epochs > 0)
    if epochs > 0:
        from wordloom.operators.train import SGNSTrainer
        tr = SGNSTrainer(vb.vocab, vb.targets, cfg)
        st = tr.train(epochs)
        model_in = st.model_in
    else:
        model_in, _ = init_weights(vb.vocab, cfg)
    model_in = normalize_rows(model_in)
    enc = encode_questions(qa, model_in, keys)
    if bundle_path:
        export_bundle(enc, vb.vocab, model_in, bundle_path)
    return enc, vb.vocab, model_in
