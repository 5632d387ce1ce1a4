"""ecolake: a PySpark library for the results of ecosystem models.

Everything is a function from DataFrames to a DataFrame (or a Column to a Column);
planning, shuffles, joins and file formats are Spark's.
"""
