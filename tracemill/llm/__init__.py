"""Training-data operators: scoring, deduplication, search, packing and fixity, one module each.

Nothing else in the library imports this subpackage.
"""
