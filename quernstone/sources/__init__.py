"""Quernstone: sources."""
