"""Assess the health of a data platform from its own metadata, as Spark jobs."""
