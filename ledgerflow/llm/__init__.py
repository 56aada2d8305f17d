"""Training-data operators: tokenisation, filtering, deduplication, packing, search and archives.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` holds the registered queries.
"""
