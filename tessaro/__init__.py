"""Territorial analytics and corpus preparation on PySpark."""
