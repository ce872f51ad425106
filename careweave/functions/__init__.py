"""Part of careweave."""
