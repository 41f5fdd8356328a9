"""Readers that give graph tables."""
