"""Grounded retrieval, record extraction and evaluation as Spark DataFrame jobs."""
