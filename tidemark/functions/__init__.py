"""Scalar and aggregate functions with the dialect's semantics, as Spark columns."""
