"""Trend-signal analytics and corpus preparation on the PySpark DataFrame API."""
