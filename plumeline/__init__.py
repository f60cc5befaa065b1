"""Batch analytics for style-conditioned product search on Spark."""
