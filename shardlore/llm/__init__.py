"""Training-data operators: search, dedup, scoring, filtering, mixing, formatting."""
