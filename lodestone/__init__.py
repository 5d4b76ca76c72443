"""Point-in-time analytics and corpus preparation on Spark DataFrames."""
