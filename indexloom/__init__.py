"""Dense n-dimensional arrays as index-keyed DataFrames, and their collective operators."""
