"""Training-data operators: quality, near-duplicates, language-model scores,
chat formatting, mixing, packing, fingerprints, sharding, toxicity and
repeated passages."""
