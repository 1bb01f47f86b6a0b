"""docaudit: auditing large document collections with Spark DataFrames."""
