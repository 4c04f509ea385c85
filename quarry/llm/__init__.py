"""Training-data operators: deduplication, filtering, extraction, mixing, formatting, search, counting."""
