"""Interval-keyed genealogies on Spark: tracks, trees, sites and their summaries as DataFrames.

Coordinates are 0-based and half-open: an interval is [start, stop).
"""
