"""Typed reads, versioned tables, JSON ingest and the test-data mapping."""
