"""tilewright: raster tile datasets, their sampling, scoring and evaluation as Spark jobs."""
