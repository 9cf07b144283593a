"""Registered queries: each runs a library operator over the driver's tables."""
