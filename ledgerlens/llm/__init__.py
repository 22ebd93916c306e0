"""Operators for training-data pipelines (documents, pages, benchmark items).

Nothing else in the library imports this subpackage.
"""
