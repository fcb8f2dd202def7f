"""Training-data operators: filters, deduplication, mixing, scoring, encoding, sharding."""
