"""Casts, the text form of nested values, and the function library."""
