"""Hybrid text search over tables of notes, as Spark jobs."""
