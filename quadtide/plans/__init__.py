"""Query languages and their compilation to DataFrames."""
