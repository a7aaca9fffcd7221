"""Operators for preparing training text, pages and vectors."""
