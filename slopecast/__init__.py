"""Geospatial hazard analytics on Spark DataFrames.

Raster layers are pixel tables, inventories are point tables, boundaries are
vertex tables and rainfall is a table or stream of timestamped readings.
"""
