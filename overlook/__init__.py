"""Terrain and viewpoint analytics on Spark: cells, observers and view signatures as DataFrames."""
