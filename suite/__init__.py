"""Queries over the driver's tables, each next to the SQL it must agree with."""
