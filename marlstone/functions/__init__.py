"""Column functions: labels, text, buckets, chains, hashing, arrays."""
