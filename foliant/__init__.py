"""Segmentation, review and revision analytics for large document collections, on Spark."""
