"""Composed plans: the preparation pipeline, the forecast experiment and the
registry of named queries with their SQL twins."""
