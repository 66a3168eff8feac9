"""Composites: whole jobs assembled from operators and functions."""
