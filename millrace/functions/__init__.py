"""Column functions: text kernel and page scorers."""
