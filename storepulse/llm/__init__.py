"""Operators for training-data pipelines over a table of documents.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_`` queries over the driver's tables.  Nothing else
in the library imports this subpackage.
"""
