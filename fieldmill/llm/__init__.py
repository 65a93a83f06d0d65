"""Operators for language-model and embedding data; the rest of fieldmill never imports this package."""
