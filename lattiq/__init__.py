"""Set-at-a-time intent resolution and offering analytics on Spark DataFrames."""
