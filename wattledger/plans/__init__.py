"""Registered queries: each reads the given tables and, where SQL can say it, has its SQL twin."""
