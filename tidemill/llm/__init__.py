"""Operators for large-scale training-data pipelines, re-expressed as Spark jobs."""
