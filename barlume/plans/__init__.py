"""Adapters from the driver's tables and the catalogue of queries."""
