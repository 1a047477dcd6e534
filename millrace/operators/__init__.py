"""Relational operators: validation, merging, splitting, distributions, selection, comparison, planning."""
