"""Scalar building blocks: quantiles and error functions."""
