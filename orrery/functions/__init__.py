"""Column functions: vectors, names, hashes, metrics."""
