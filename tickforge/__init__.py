"""Tick analytics on Spark."""
