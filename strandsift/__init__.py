"""Searching text and nucleotide sequences on Spark."""
