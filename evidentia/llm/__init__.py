"""Training-data operators: mixing, dedup, tokenisation, extraction, scoring, filtering, search, fingerprints."""
