"""Repository-activity analytics written for PySpark.

Every operator takes DataFrames and returns a DataFrame, works for all
repositories in one job, and takes its reference time as an argument.
"""
