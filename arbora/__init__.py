"""Document-tree analytics and data processing on PySpark."""
