"""Comparable-property analytics on Spark."""
