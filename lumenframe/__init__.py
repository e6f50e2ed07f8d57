"""Lumenframe: a PySpark engine for curating media and document libraries."""
