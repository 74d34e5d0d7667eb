"""Operators of the raster dataset engine."""
