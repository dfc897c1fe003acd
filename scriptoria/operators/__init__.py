"""Operators on documents."""
