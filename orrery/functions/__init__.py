"""Operators on vectors, element access and orderings built from native column expressions."""
