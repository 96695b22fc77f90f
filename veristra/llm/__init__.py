"""Training-data operators: sharding, search, filtering, deduplication, mixing and packing."""
