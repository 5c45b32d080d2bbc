"""DataFrame operators: each takes DataFrames and parameters and returns a
DataFrame, with no action inside unless its docstring says so."""
