"""Column-level functions: everything here maps Columns to Columns."""
