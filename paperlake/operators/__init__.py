"""Operators on LaTeX documents: the per-document kernel and the tables that drive it."""
