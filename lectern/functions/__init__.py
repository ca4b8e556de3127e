"""Part of the archive engine."""
