"""Registered queries (Spark plans) with their DuckDB oracle SQL."""
