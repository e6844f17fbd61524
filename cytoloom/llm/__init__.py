"""Operators of a training-data pipeline: text, url and archive components over DataFrames.

Nothing outside this subpackage imports it.
"""
