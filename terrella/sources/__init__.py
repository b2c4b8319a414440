"""Readers and writers of geometry and raster formats."""
