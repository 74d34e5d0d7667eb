"""Sources of the raster dataset engine."""
