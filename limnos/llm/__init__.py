"""Operators that prepare training text: joins, searches, deduplication, extraction, mixing, sharding, archives."""
