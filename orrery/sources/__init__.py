"""Table readers, dataset providers and writers."""
