"""Sources of the session engine."""
