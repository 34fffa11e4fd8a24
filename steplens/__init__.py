"""Step-indexed analytics on Spark."""
