"""Operators over DataFrames: filters, joins, aggregations, windows, tiles and rasters."""
