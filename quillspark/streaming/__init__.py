"""Arrival streams."""
