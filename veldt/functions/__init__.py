"""Scalar functions and aggregates with the engine's own semantics."""
