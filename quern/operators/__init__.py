"""Samplers, estimators, the accuracy contract and sketches, over DataFrames."""
