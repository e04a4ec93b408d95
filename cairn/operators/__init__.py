"""Operators over station and observation tables."""
