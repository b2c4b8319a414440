"""Geospatial raster and vector analytics on Spark DataFrames."""
