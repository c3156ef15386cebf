"""Plans of the session engine."""
