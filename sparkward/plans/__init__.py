"""Registered queries: each plan module has QUERIES, name to (function, SQL or None)."""
