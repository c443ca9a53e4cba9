"""Schemas, file readers and writers, and views over the shared test tables."""
