"""Composite analytic queries and the query catalogue with its SQL twins."""
