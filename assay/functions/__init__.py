"""Scalar functions over columns, and their SQL forms."""
