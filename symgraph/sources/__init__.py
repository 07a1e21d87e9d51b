"""Readers of source trees."""
