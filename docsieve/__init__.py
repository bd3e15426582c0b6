"""Grounded document analytics on Spark."""
