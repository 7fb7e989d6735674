"""History-DAG analytics on PySpark: many alternative trees in plain DataFrames."""
