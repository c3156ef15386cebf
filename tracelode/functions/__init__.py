"""Functions of the session engine."""
