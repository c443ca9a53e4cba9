"""Lending-risk and return-signal analytics as plain PySpark DataFrame code."""
