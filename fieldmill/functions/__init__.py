"""Part of fieldmill."""
