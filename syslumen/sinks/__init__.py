"""Sinks of the log engine."""
