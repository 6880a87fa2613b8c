"""tsugumi: hybrid document retrieval and corpus processing as declarative PySpark plans."""
