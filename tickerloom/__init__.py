"""Market-and-news panel analytics on Spark DataFrames."""
