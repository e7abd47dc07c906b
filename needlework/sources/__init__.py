"""Stored pattern sets."""
