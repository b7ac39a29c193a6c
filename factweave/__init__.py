"""A conceptual query engine on PySpark."""
