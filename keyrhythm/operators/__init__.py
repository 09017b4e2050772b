"""DataFrame operators: each maps DataFrames to a DataFrame, columns given as parameters."""
