"""Training-data operators: tokens, duplicates, quality, personal data, shards and packing."""
