"""Queries made of several operators."""
