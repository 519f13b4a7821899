"""Quality checks and analytics for monthly trip batches, on Spark DataFrames."""
