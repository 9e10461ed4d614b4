"""Spark jobs for drug-target binding-affinity data."""
