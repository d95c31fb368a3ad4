"""Whole plans over a bundle: daily panel, forecasts, timeline, views."""
