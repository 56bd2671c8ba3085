"""Training-data operators: licence scans, WARC, mixing, fingerprints, search, near-duplicates,
passages, language-model scoring, packing and language identification."""
