"""Training-data operators: search, mixing, filtering, dedup and tokenisation of corpora."""
