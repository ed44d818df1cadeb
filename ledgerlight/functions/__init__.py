"""Column functions: cleaning, statistics, vectors."""
