"""Operators on history DAGs: each takes and returns DataFrames."""
