"""Streams into a table."""
