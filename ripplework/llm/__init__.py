"""Operators a training-data pipeline needs, beside the change-intelligence library."""
