"""Content-snapshot analytics on Spark: DataFrame, SQL and Structured Streaming operators."""
