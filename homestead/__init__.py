"""Homestead: tabular analytics, neighbour models and validation as Spark jobs."""
