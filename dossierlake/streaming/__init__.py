"""Event-time variants of the operators."""
