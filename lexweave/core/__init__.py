"""Comparison of two texts in plain Python: no Spark here."""
