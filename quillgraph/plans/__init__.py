"""The filter record and its compilation to DataFrames."""
