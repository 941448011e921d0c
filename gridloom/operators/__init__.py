"""Reductions, elementwise operators, application of functions, masks, indexing."""
