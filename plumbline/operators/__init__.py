"""Operators over DataFrames: query language, joins, cleaning, profiles, statistics, models, detectors."""
