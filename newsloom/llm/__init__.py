"""Operators for preparing training text: deduplication, scoring, tokenising, packing, archives.

Nothing else in the library imports this package. Each operator is a module; ``queries`` registers one query per
operator and ``oracles`` the SQL for those that SQL can express.
"""
