"""Array kernels without Spark: one image at a time."""
