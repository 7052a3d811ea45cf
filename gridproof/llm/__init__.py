"""Training-data operators: tokens, duplicates, fingerprints, packing, languages, mixing, quality and HTML."""
