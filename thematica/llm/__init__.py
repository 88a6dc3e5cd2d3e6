"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers them under their contract names.
"""
