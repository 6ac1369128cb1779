"""A PySpark-native engine for raster, vector and learning queries over DataFrames."""
