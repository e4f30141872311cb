"""Scalar logic as Column expressions (no Python runs per row)."""
