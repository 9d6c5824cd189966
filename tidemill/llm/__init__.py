"""Operators for preparing training text and media at scale.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface and the thin ``opN_*`` query that applies it to a whole table.
"""
