"""Column functions: keys, geometry, scalars and pixels.  Each takes and returns Spark columns."""
