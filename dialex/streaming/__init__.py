"""Counting as documents arrive."""
