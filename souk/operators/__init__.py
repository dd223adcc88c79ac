"""Relational operators composed from DataFrame operations."""
