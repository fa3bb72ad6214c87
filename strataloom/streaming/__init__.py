"""Stateful operators over event time."""
