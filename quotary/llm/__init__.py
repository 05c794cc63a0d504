"""Training-data operators: sharding, similarity joins, scoring, mixing, scans and counts over document tables."""
