"""Ordered and windowed evaluation over streams."""
