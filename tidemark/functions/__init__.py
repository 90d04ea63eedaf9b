"""Checksums, bloom filters and percentiles."""
