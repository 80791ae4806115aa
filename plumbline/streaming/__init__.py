"""Snapshots and updates that arrive over time."""
