"""Spark jobs for ranked memory retrieval, its telemetry, and its data quality."""
