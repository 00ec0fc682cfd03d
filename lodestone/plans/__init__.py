"""Lodestone: plans."""
