"""Training-data operators: deduplication, filters, search, mixing and packing over document tables.

Nothing else in the library imports this subpackage.
"""
