"""Readers of tabular files and writers of results."""
