"""The market tables, each a function from DataFrames to a DataFrame."""
