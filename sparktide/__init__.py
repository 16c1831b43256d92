"""Time-series analytics on Spark."""
