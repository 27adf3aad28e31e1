"""Page-comparison analytics and corpus preparation on Spark DataFrames."""
