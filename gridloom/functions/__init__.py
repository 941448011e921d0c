"""Scalar semantics that Spark's own functions don't have."""
