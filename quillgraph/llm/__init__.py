"""Training-data operators: formatting, deduplication, tokens, quality, secrets, mixing and sharding."""
