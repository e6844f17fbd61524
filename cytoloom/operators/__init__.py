"""Operators over cell tables, in the order in which an analysis uses them."""
