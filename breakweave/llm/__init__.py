"""Training-data operators: deduplication, scoring, search, encoding, packing and filters for text corpora."""
