"""Graph operators: DataFrames of nodes and edges in, DataFrames out."""
