"""Hyperparameters and flags (one frozen dataclass, defaults as published)."""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# These must equal the reference system's constants for the
# results to match.
#   word delimiters (bytes):      space tab , : ; ( ) { } [ ] < > " ' ’ / \ % # $ & ~ * + = ^ _
#   sentence delimiters (bytes):  . ? ! newline carriage-return
#   question/answer separator:    =~=~>
# ---------------------------------------------------------------------------
WORD_DELIMITERS = " \t,:;(){}[]<>\"'’/\\%#$&~*+=^_"
SENTENCE_DELIMITERS = ".?!\n\r"
QA_SEPARATOR = "=~=~>"

SAMPLERS = ("unigram", "unigram_literal", "tdnd", "tdnd_literal")


@dataclass(frozen=True)
class Config:
    """Training / vocabulary configuration.

    Defaults follow the published compile-time defaults: 50 dimensions,
    10 epochs, window 5 (the current token plus 4 previous), 25 samples
    (1 positive + 24 negatives), learning rate 0.05 decaying to 1e-4,
    low-frequency bound 5, high-frequency ratio 0.01, 5 predictions,
    10 distribution buckets.
    """

    hidden: int = 50
    epochs: int = 10
    window: int = 5
    samples: int = 25
    lr_max: float = 0.05
    lr_min: float = 0.0001
    low_bound: int = 5
    high_ratio: float = 0.01
    predictions: int = 5
    buckets: int = 10
    # flags
    stop: bool = True
    low: bool = True
    high: bool = True
    stem: bool = False
    strip_all: bool = False          # strip every trailing sentence byte, not just one
    sampler: str = "unigram"         # one of SAMPLERS
    # execution
    seed: int = 0
    batch: int = 64                  # examples of a center whose gradients are taken at once; 1 is the original's order
    train_partitions: int = 0        # least number of parts; 0 = as many as the examples ask for
    blocks: int = 0                  # blocks per layer; 0 = as many as the model's size asks for (4 at least)
    block_bytes: int = 32 * 1024 * 1024              # bytes of one layer's block, at most

    def __post_init__(self):
        if self.sampler not in SAMPLERS:
            raise ValueError(f"sampler must be one of {SAMPLERS}, got {self.sampler!r}")
        if self.window < 2:
            raise ValueError("window must be >= 2")
        if self.batch < 1:
            raise ValueError("batch must be >= 1")

    @property
    def context(self) -> int:
        """Number of previous kept tokens a token pairs with."""
        return self.window - 1

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)

    def learning_rate(self, epoch: int) -> float:
        """alpha(epoch) = max(lr_min, lr_max * (1 - epoch / epochs))."""
        return max(self.lr_min, self.lr_max * (1 - epoch / self.epochs))

    def learning_rate_column(self, epoch):
        """The same of an epoch column."""
        from pyspark.sql import functions as F
        return F.greatest(F.lit(self.lr_min), F.lit(self.lr_max) * (F.lit(1.0) - epoch / F.lit(float(self.epochs))))
