"""Lodestone: operators."""
