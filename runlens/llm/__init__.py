"""Training-data operators: scoring, deduplication, filtering, formatting, archiving, packing.

Nothing else in the library imports this subpackage.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` hold the thin queries over the synthetic tables.
"""
