"""Analytics for activity logs recovered from screenshots, on Spark DataFrames."""
