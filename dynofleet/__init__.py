"""Spark jobs over fleets of engine-tuning data: datalogs, flash images, definitions and records."""
