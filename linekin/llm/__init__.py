"""Training-data operators: dedup, PII, nearest neighbours, mixing, tokenization, HTML text, quality."""
