"""Scalar functions as column expressions, and the few vectorised Python ones."""
