"""DataFrame -> DataFrame operators (vote, sequences, labels, alignment,
splits, metrics, embedding, similarity search, training, scoring)."""
