"""Part of the palimpsest package."""
