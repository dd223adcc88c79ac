"""Structured Streaming jobs: landing, activity, live overlay, write-back, windows."""
