"""Tender-evaluation analytics and large-scale text operators on Spark DataFrames."""
