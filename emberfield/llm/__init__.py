"""Training-data operators: tokenising, scoring, filtering, deduplicating, redacting, packing and search."""
