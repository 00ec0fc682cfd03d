"""Lodestone: sources."""
