"""Network-security analytics on Spark DataFrames and Structured Streaming."""
