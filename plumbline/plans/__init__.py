"""Staged analyses and their audit."""
