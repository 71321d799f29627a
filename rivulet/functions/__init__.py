"""Scalar functions as Spark columns."""
