"""spanforge: span, fact and text analytics on Spark DataFrames."""
