"""geolith: data quality of vector geospatial tables on Spark.

Operators take and return DataFrames. See README.md for the catalogue.
"""
