"""Training-data operators: dedup, counting, formatting, packing, filtering, search."""
