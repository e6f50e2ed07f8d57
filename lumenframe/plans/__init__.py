"""Registered queries and the relations that they run on."""
