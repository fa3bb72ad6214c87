"""Operators on texts, code and vectors of a training-data pipeline. Nothing outside this package imports it."""
