"""Operators of a training-data pipeline, one module each; ``queries`` registers them.

Nothing outside this package imports it.
"""
