"""Spark jobs for feedback and catalogue data at scale."""
