"""Longitudinal cohort analytics on Spark."""
