"""Retrieval, document and conversation analytics on PySpark."""
