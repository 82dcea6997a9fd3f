"""Full-text retrieval and ranking on Spark DataFrames."""
