"""Marts, forecasts, overlays, alerts and reports as DataFrame functions."""
