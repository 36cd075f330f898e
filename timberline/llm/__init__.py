"""Training-data operators: deduplication, filtering, mixing, packing, counting."""
