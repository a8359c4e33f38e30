"""Spatial-zone training datasets as PySpark DataFrame jobs."""
