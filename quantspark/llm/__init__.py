"""Training-data operators: mixing, dedup, scoring, tokenising, packing and sharding of document tables."""
