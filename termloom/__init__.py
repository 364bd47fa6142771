"""Full-text retrieval and link analysis on Spark DataFrames."""
