"""Bi-temporal fact graphs on Spark."""
