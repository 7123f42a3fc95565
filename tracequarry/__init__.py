"""Analytics over completed execution traces, on Spark DataFrames."""
