"""Spark jobs that release person-level tables under k-anonymity."""
