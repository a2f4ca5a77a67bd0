"""Training-data operators: deduplication, tokenising, scoring, mixing, formatting."""
