"""Training-data operators: scoring, sharding, archives, language, quality, extraction, dedup, tokens, decontamination."""
