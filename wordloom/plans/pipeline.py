"""P2 build_vocabulary and friends: compose the operators into the corpus plan.

Tables that later steps reuse (word counts, the frozen rank tables behind
the high filter and the index, undirected pair counts) are written to the
shared checkpoint folder once, so a lost executor re-reads them instead of
re-tokenising the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.config import Config
from wordloom.operators import cooc as CO
from wordloom.operators import tokens as TK
from wordloom.operators import vocab as VC
from wordloom.session import materialize


@dataclass
class VocabBuild:
    sents: DataFrame
    wf: DataFrame
    v_raw: int
    removed: DataFrame
    vocab: DataFrame
    und: DataFrame | None = None           # counts of all unordered pairs, of removed words too (not computed unless used)
    targets: DataFrame | None = None
    pair_count: int | None = None          # Σ of ``und``: counted while the targets' pairs were


def build_vocabulary(docs: DataFrame, cfg: Config = Config(), stops: list[str] | None = None,
                     with_targets: bool = True, text_col: str = "text",
                     id_col: str = "doc_id") -> VocabBuild:
    """Corpus → kept tokens → counts → filters → indexed vocabulary (+ targets).

    With targets the tokenised sentences are written once: words are counted
    first, then pairs, and only pairs of kept words are shuffled.
    """
    spark = docs.sparkSession
    sents = TK.sentences(docs, cfg, stops, text_col=text_col, id_col=id_col)
    if with_targets:
        sents = materialize(sents, spark, "sentences")
    wf = materialize(VC.word_freq(sents), spark, "word_freq")
    v_raw = wf.count()
    kept, removed = VC.vocab_filter(wf, cfg, v_raw)
    # both derive from written tables only (word counts, frozen rank tables), so
    # they stay lazy: re-reading them is as cheap as writing them again
    vocab = VC.vocab_index(kept)
    vb = VocabBuild(sents, wf, v_raw, removed, vocab)
    if with_targets:
        seed = CO.key_seed(wf)
        pairs = materialize(CO.kept_pairs(sents, vocab, seed, cfg), spark, "pairs")
        vb.und = CO.undirected_counts(sents, cfg)
        vb.targets = CO.vocab_targets(pairs, vocab, seed)
        vb.pair_count = int(pairs.where(F.col("a").isNull()).agg(F.sum("freq")).first()[0] or 0)
    return vb
