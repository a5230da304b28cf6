"""Operators over tables of notes, chunks, queries and answers."""
