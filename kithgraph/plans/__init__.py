"""Whole queries: ego networks, views, registered query catalogue."""
