"""Unbounded sources and windows over streams."""
