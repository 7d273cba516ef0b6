"""Readers and the stand-in tables derived from the test tables."""
