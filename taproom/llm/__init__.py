"""Operators of a training-data pipeline: one module each, with its registered query."""
