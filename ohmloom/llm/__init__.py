"""Training-data operators.

Nothing outside this subpackage imports it.  Every module holds one operator with a general interface and
the thin ``opN_*`` query that applies it to a whole table.
"""
