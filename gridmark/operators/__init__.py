"""Table-level operators: DataFrames in, DataFrame out."""
