"""Selections, reductions and lazy frames."""
