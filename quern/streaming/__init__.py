"""Streams that feed samples and top-K tables."""
