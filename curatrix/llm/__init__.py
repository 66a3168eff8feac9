"""Operators that prepare catalogue texts and vectors for model training."""
