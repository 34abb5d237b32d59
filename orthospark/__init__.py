"""orthospark: catalog, search and process large archives of aerial imagery with Spark DataFrames."""
