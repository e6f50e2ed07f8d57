"""Relational and analytic operators over the catalog."""
