"""Training-data operators: language, secrets, scoring, mixing, quality, dedup, packing, archives, search."""
