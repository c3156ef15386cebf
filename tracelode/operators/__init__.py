"""Operators of the session engine."""
