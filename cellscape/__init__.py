"""Raster and annotation analytics over Spark tables.

A pixel is a row, a tile or map is a key, a painting is a table of cells and a
catalog is a table of records.  Every operator takes and returns DataFrames.
"""
