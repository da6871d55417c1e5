"""Operators for large text corpora (training-data preparation).

Nothing else in the library imports this subpackage. Each module is one
operator; ``queries`` binds them to the driver tables.
"""
