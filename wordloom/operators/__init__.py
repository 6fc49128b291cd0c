"""DataFrame operators: tokens, vocabulary, co-occurrence, sampling, training, search."""
