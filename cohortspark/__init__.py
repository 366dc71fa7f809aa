"""Cohort analytics and file registry on Spark DataFrames."""
