"""Narrative text analytics on Spark."""
