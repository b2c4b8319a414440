"""Operators over DataFrames: tilings, spatial joins, rasters, geometry kernels, fits."""
