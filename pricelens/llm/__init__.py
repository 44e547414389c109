"""Training-data operators over the ``documents``-like tables.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries and their SQL.
"""
