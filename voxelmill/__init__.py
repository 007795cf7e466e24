"""Spark-native analytics over sparse 3-D masks, image-series catalogues and registration experiments."""
