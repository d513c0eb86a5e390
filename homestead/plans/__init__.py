"""Pipelines over several tables."""
