"""Column functions: distances, JSON metadata and word tokens."""
