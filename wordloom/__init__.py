"""wordloom — word and sentence embeddings over large text collections, on Spark.

Tokenising, vocabulary building, window co-occurrence counting, skip-gram
training with negative sampling, and the similarity / context / sentence /
question-answer queries around them, all expressed as DataFrame jobs.
"""

from wordloom.config import Config

__all__ = ["Config"]
