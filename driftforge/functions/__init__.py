"""Part of the drift and plan analytics engine."""
