"""Readers of array files as Spark data sources."""
