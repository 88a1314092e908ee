"""Scalar rules as Column expressions; all of them run within generated code."""
