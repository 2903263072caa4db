"""Text search and relevance on Spark DataFrames."""
