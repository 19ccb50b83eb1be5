"""Operators of a training-data pipeline, one module each; queries.py applies them to whole tables."""
