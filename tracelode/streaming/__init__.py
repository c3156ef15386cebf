"""Streaming of the session engine."""
