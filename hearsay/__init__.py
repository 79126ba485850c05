"""Opinion analytics and text preparation on Spark DataFrames."""
