"""Plans: search requests and index builds put together from the operators."""
