"""Element types and functions of NumPy."""
