"""Operators on whole frames: projection, validity, joins, aggregates, neighbours, models, validation."""
