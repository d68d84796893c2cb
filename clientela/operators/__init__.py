"""Building blocks: plain functions from DataFrames to a DataFrame."""
