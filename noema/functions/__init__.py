"""Part of noema."""
