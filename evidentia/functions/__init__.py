"""Dated-evidence analytics on Spark."""
