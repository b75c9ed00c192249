"""Driver queries and their fixtures."""
