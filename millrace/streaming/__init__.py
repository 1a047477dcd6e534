"""Streams of records through the same Column functions."""
