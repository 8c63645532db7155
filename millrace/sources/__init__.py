"""Readers, file discovery and generated data."""
