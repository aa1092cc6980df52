"""Citation-graph analytics on PySpark."""
