"""Composite plans (the reference's entry points) and the query registry."""
