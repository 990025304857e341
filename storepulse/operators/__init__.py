"""Operators: DataFrame → DataFrame transformations for each SURVEY §2 group."""
