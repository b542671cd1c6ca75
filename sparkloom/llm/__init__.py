"""Training-data operators: tokenising, deduplication, packing, scoring, archives."""
