"""Registered queries over the standard tables, each with SQL of its own for comparison."""
