"""Queries over the driver's tables, and the detection plan."""
