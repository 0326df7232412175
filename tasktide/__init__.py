"""Change-driven task planning and analytics on Spark DataFrames."""
