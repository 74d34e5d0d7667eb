"""Plans of the raster dataset engine."""
