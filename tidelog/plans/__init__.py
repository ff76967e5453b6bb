"""Registered queries: input adapters over the given tables, the queries, and their SQL twins."""
