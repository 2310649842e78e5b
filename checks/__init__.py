"""Queries over the driver tables and the SQL each one must agree with."""
