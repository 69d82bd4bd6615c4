"""Training-data operators: extraction, deduplication, packing, classification, search and tokenisation.

Nothing else in the library imports this subpackage.
"""
