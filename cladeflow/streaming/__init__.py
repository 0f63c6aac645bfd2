"""Placement of queries that arrive as a stream."""
