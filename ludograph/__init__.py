"""Ludograph: record and step-sequence analytics as PySpark DataFrame operators."""
