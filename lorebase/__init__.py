"""lorebase: evidence history and corpus processing on Spark DataFrames."""
