"""Set and sequence analytics as DataFrame, SQL and Structured Streaming operators."""
