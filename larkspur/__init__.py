"""Larkspur: a relational SQL engine on PySpark, planned by Catalyst."""

__version__ = "0.1.0"
