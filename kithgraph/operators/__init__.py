"""Graph, tree and timeline operators on DataFrames."""
