"""Lodestone: streaming."""
