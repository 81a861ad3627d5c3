"""Gaugeworks: evaluation and measurement analytics on PySpark."""
