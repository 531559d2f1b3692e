"""Operators on frames of runs."""
