"""Readers and writers of chat records, pages and reports."""
