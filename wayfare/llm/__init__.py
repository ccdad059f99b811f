"""Training-data operators: each works on DataFrames and is independent of the rest of the library."""
