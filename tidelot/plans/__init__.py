"""Queries by name, with the SQL that states each one's result."""
