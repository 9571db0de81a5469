"""Training-data operators: filtering, deduplication, scoring and tokenising of large text tables."""
