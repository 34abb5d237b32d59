"""Reading and writing: the footprint lake, listings, image headers and Parquet footers."""
