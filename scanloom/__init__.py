"""Security-findings analytics as Spark DataFrame, SQL and Structured Streaming code."""
